"""Benchmark decontamination with training suffix arrays.

Documents are cut into shards of about ``shard_words`` words, each held by one task.  A shard gets a suffix array over its
words; every suffix of every benchmark text is looked up in it by binary search, which yields the longest
verbatim match and all of its places.  Nothing is shuffled: a shard never needs another one.

The suffix array is refined by rank doubling (1, 2, 4, 8, ... words), and each refinement keeps only suffixes that start a
word run the benchmark holds; all others cannot be an answer to any lookup.  Word ranks come from the benchmark's
own vocabulary, compared byte by byte, so no match rests on a hash.

The benchmark travels with the tasks.  ``MAX_WORDS`` words at most go at a time; a larger benchmark is split by item and the
documents are scanned once per part.

Defined cases: null and empty texts have no words and match nothing; items without words are never matched; equal
item rows count once per distinct item_id; null item_ids are left out; document rows are answered one by one, so repeated rows
and null doc_ids simply get their own answers; extra columns are carried by ``matches``/``contamination`` only when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.session import checkpointed

WINDOW = 13
SHARD_WORDS = 1 << 19
MAX_WORDS = 1 << 21


class Benchmark:
    """All suffixes of the benchmark texts as sequences of word ids; id 0 is any word that no item holds."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        words: dict[bytes, int] = {}
        rows, starts = [], [0]
        for _, text in items:
            block = X.Block(0, np.array([0, len(text)]), X.LOWER[np.frombuffer(text, np.uint8)])
            data = block.data.tobytes()
            rows += [words.setdefault(data[a:b], len(words) + 1) for a, b in zip(*X.spans(block, X.WORD_BYTES), strict=True)]
            starts.append(len(rows))
        self.words = np.array(rows, np.int64)
        self.starts = np.array(starts, np.int64)
        self.item = np.repeat(np.arange(len(items)), np.diff(self.starts))
        self.left = self.starts[self.item + 1] - np.arange(len(rows))  # words up to the end of the item
        self.window = window
        longest = max([1, *map(len, words)])
        self.spelled = sorted(words)
        self.rank = np.array([words[w] for w in self.spelled], np.int64)
        # words are found by length and hash first, then compared byte by byte
        joined = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in self.spelled])]).astype(np.int64)
        sums = X.prefix_sums(joined)
        hashes = X.span_hash(sums, self.at[:-1], self.at[1:]) if self.spelled else np.zeros(0, X.U)
        self.order = np.argsort(hashes)
        self.hashes, self.joined, self.longest = hashes[self.order], joined, longest

    def word_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int64)
        if not len(starts) or not self.spelled:
            return out
        hashes = X.span_hash(X.prefix_sums(data), starts, ends)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[near] == hashes)
        word = self.order[near[found]]
        size = ends[found] - starts[found]
        same = size == self.at[word + 1] - self.at[word]
        found, word, size = found[same], word[same], size[same]
        equal = data[X.ranges(starts[found], size)] == self.joined[X.ranges(self.at[word], size)]
        bad = np.add.reduceat(~equal, np.concatenate([[0], np.cumsum(size)[:-1]])) > 0 if len(found) else np.zeros(0, bool)
        out[found[~bad]] = self.rank[word[~bad]]
        return out


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) * (1 << 31) + second


class Shard:
    """Suffix array of the words of some documents, as deep as the window, over suffixes a lookup can end in."""

    def __init__(self, words: np.ndarray, bench: Benchmark):
        """words: ids with 0 between documents."""
        self.words, self.bench = words, bench
        self.text = np.concatenate([words, np.zeros(1, np.int64)])
        places = np.flatnonzero(words > 0)
        rank, query, depth = words[places], bench.words.copy(), 1
        # levels: (depth, places sorted by their first `depth` words, their ranks, the rank of each test suffix or 0)
        self.levels = []
        self._add(depth, places, rank, query)
        while depth < bench.window:
            step = min(depth, bench.window - depth)
            depth, places, rank, query = self._deeper(depth, step)
            self._add(depth, places, rank, query)

    def _add(self, depth, places, rank, query):
        order = np.lexsort((places, rank))
        self.levels.append((depth, places[order], rank[order], query))

    def _deeper(self, depth: int, step: int):
        """Suffixes ranked by depth + step words: by their first ``depth`` words and the ``depth`` words from ``step`` on."""
        _, places, rank, query = self.levels[-1]
        dense = np.zeros(len(self.text) + depth + step, np.int64)
        dense[places] = rank
        n = len(query)
        tail = np.zeros(n, np.int64)
        has = np.flatnonzero(self.bench.left >= depth + step)
        tail[has] = query[has + step]
        key = np.where((query > 0) & (tail > 0), _pairs(query, tail), 0)
        mine = dense[places + step]
        own = _pairs(rank, mine)
        wanted = np.unique(key[key > 0])
        if not len(wanted):
            return depth + step, places[:0], rank[:0], np.zeros(n, np.int64)
        near = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        keep = (mine > 0) & (wanted[near] == own)
        q = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        return depth + step, places[keep], near[keep] + 1, np.where((key > 0) & (wanted[q] == key), q + 1, 0)

    def lookup(self, level: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, place) of every place where the first words of the given test suffixes stand, by binary search."""
        _, places, rank, query = self.levels[level]
        which = which[query[which] > 0]
        lo, hi = np.searchsorted(rank, query[which], "left"), np.searchsorted(rank, query[which], "right")
        return np.repeat(which, hi - lo), places[X.ranges(lo, hi - lo)]

    def equal(self, suffix: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a place are those of the suffix."""
        if not len(suffix):
            return np.zeros(0, bool)
        same = self.text[X.ranges(place, size)] == self.bench.words[X.ranges(suffix, size)]
        return np.add.reduceat(~same, np.concatenate([[0], np.cumsum(size)[:-1]])) == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, place, words) of every occurrence of a window: ``window`` words, or a whole shorter item."""
        left, window, out = self.bench.left, self.bench.window, []
        out.append((*self.lookup(len(self.levels) - 1, np.flatnonzero(left >= window)), window))
        heads = self.bench.starts[:-1][np.diff(self.bench.starts) > 0]
        for size in np.unique(left[heads][left[heads] < window]):
            level = max(k for k, x in enumerate(self.levels) if x[0] <= size)
            suffix, place = self.lookup(level, heads[left[heads] == size])
            room = place + size <= len(self.words)
            suffix, place = suffix[room], place[room]
            same = self.equal(suffix, place, np.full(len(suffix), size))
            out.append((suffix[same], place[same], int(size)))
        return tuple(np.concatenate([x[k] if k < 2 else np.full(len(x[0]), x[2]) for x in out]) for k in range(3))

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, place, words): each window's occurrence that no longer one holds, extended as far as it is verbatim."""
        suffix, place, size = self.windows()
        before = np.where(suffix > self.bench.starts[self.bench.item[suffix]], self.bench.words[suffix - 1], -1)
        head = (place == 0) | (before < 0) | (self.text[place - 1] != before)
        suffix, place, size = suffix[head], place[head], size[head].copy()
        grown = np.ones(len(suffix), bool)
        while grown.any():
            at = np.flatnonzero(grown)
            grown[at] = size[at] < self.bench.left[suffix[at]]
            at = np.flatnonzero(grown)
            same = self.text[np.minimum(place[at] + size[at], len(self.text) - 1)] == self.bench.words[suffix[at] + size[at]]
            grown[at[~same]] = False
            size[at[same]] += 1
        return suffix, place, size


def _shards(batches: Iterator[pa.RecordBatch], bench: Benchmark, shard_words: int):
    """(batch, first row, end row, words per row, Shard, row of each word) for runs of rows."""
    for batch in batches:
        held, first, count = [], 0, 0
        row = 0
        for block in X.blocks(batch.column("text")):
            data = X.LOWER[block.data]
            starts, ends = X.spans(X.Block(0, block.offsets, data), X.WORD_BYTES)
            ids = bench.word_ids(data, starts, ends)
            bounds = np.searchsorted(starts, block.offsets)
            held.append((ids, np.diff(bounds)))
            count += len(ids)
            row = block.first + len(block)
            if count >= shard_words:
                yield batch, first, row, *_shard(held, bench)
                held, first, count = [], row, 0
        if held:
            yield batch, first, row, *_shard(held, bench)


def _shard(held, bench):
    ids = np.concatenate([x[0] for x in held])
    sizes = np.concatenate([x[1] for x in held])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(ids) + len(sizes), np.int64)  # a 0 behind each document keeps matches inside
    text[np.arange(len(ids)) + rows] = ids
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return sizes, starts, Shard(text, bench)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def _parts(benchmark: DataFrame, max_words: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """The benchmark in parts of about ``max_words`` words (at least one item each); the driver holds one part at a time."""
    items = _items(benchmark)
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = int(total // max_words) + 1
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).select("item_id", "text").collect()
        yield part == n - 1, sorted((r["item_id"], r["text"].encode()) for r in rows)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, doc_word, item_id, item_word, words): longest verbatim matches of at least a window, with their places."""
    out = None
    for _, items in _parts(benchmark, max_words):

        def find(batches, items=items):
            bench = Benchmark(items, window)
            for batch, first, _, sizes, starts, shard in _shards(batches, bench, shard_words):
                suffix, place, size = shard.longest()
                row = np.searchsorted(starts, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row + first)), pa.array(place - starts[row]), pa.array([bench.ids[k] for k in bench.item[suffix]], pa.string()), pa.array(suffix - bench.starts[bench.item[suffix]]), pa.array(size.astype(np.int64))],
                    ["doc_id", "doc_word", "item_id", "item_word", "words"],
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, doc_word bigint, item_id string, item_word bigint, words bigint")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, shard_words: int = SHARD_WORDS, max_words: int = MAX_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the columns named in ``carry``, one row per document.

    Contaminated: at least one word in ``share`` lies in an occurrence of a window.  A benchmark in several parts takes one
    scan per part; the runs of hit words and the items found so far travel with the row, written to the shared folder in between.
    """
    keep = ["doc_id", *[c for c in carry if c != "doc_id"]]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in [*keep, "text"]}
    state = docs.select(*dict.fromkeys([*keep, "text"])).withColumns({"hits_": F.lit(None).cast("binary"), "items_": F.lit(None).cast("array<string>")})
    for last, items in _parts(benchmark, max_words):
        names = keep if last else list(dict.fromkeys([*keep, "text"]))
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + (", n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" if last else ", hits_ binary, items_ array<string>")
        state = state.mapInArrow(partial(_judge, items=items, names=names, last=last, window=window, share=share, shard_words=shard_words), schema)
        if not last:
            state = checkpointed(state)
    return state


def _judge(batches, items, names, last, window, share, shard_words):
    bench = Benchmark(items, window)
    for batch, first, end, sizes, starts, shard in _shards(batches, bench, shard_words):
        rows = batch.slice(first, end - first)
        suffix, place, size = shard.windows()
        hits, before, known = [(place, place + size)], rows.column("hits_"), rows.column("items_").to_pylist()
        for k in np.flatnonzero(~np.asarray(before.is_null())):
            pairs = np.frombuffer(before[int(k)].as_py(), np.int64).reshape(2, -1)
            hits.append((pairs[0] + starts[k], pairs[1] + starts[k]))
        mask = X.covered(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), len(shard.words))
        found: list[set[str]] = [set(x or ()) for x in known]
        row = np.searchsorted(starts, place, "right") - 1
        both = np.unique(_pairs(row, bench.item[suffix]))
        for r, i in zip(both >> 31, both & ((1 << 31) - 1), strict=True):
            found[r].add(bench.ids[i])
        if last:
            total = np.concatenate([[0], np.cumsum(mask)])
            n_hit = total[starts + sizes] - total[starts]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found]
            own = [pa.array(sizes.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (share * n_hit >= sizes))]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], *own], [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
        else:
            runs = [X.runs(mask[s : s + n]) for s, n in zip(starts, sizes, strict=True)]
            own = [pa.array([np.concatenate(r).astype(np.int64).tobytes() for r in runs], pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], *own], [*names, "hits_", "items_"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    plain, back = X.neutral(docs, "doc_id", "text")
    return back(contamination(plain, benchmark, carry=tuple(plain.columns), **settings).where("NOT contaminated"))
