"""Line dedup over content-defined chunks of lines, every hit grown to all the lines that are repeated around it.

Chunks are those of ``line_chunks`` (a rolling hash over line hashes sets shift-resistant boundaries), with a one-line tail joined to the
chunk before it.  Chunks alone miss the ends of a repeat and repeats shorter than a chunk, so three kinds of units are compared:

* chunks of two lines or more, whatever they hold;
* windows of two consecutive lines with ``window_words`` words or more: overlapping windows grow a chunk hit line by line in both
  directions, and find repeats that hold no whole chunk;
* single lines of ``line_words`` words or more.

A unit that stands earlier in the corpus (by doc_id, text hash, place) goes with its lines.  Equal units meet by two 64-bit hashes on
narrow rows, then their bytes are compared as the smallest and the largest behind one pair of hashes, which Spark reduces before it
shuffles.  Windows within a repeated chunk say nothing new and are not compared: what repeats a chunk repeats its windows, so no window
stands first there.  The first place of every line therefore stays, though a first pair may lose a line that stands earlier in other company.

Defined cases: null text stays null and has no lines; an empty text has one empty line; lines end at \\n alone; words are runs of
bytes other than blanks; a unit may repeat within one text; rows equal in doc_id and text are one document for the order, so they keep or
lose the same lines; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.llm.line_chunks import Lines
from webloom.llm.tables import discard, written

WINDOW_WORDS = 8
LINE_WORDS = 50
UNIT = "doc_id_ {kind}, key_ bigint, low int, high int, h1 bigint, h2 bigint"
NAMES = ["doc_id_", "key_", "low", "high", "h1", "h2"]


class Units:
    """Lines, chunks and units of the rows of a block; ``low`` and ``high`` are the first and last line of a unit, counted in the block."""

    def __init__(self, block: X.Block, window_words: int, line_words: int):
        lines = Lines(block)
        self.row, self.start, self.end = lines.row, lines.start, lines.end
        self.heads = np.searchsorted(self.row, np.arange(len(block)))
        # a one-line tail goes to the chunk before it
        tail = ~lines.many[1:] & (lines.of_row[1:] == lines.of_row[:-1])
        last = np.delete(lines.last, np.flatnonzero(tail))
        first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
        self.chunk = np.repeat(np.arange(len(last)), last - first + 1)  # of every line
        words = X.spans(block, X.DARK_BYTES)[0]
        count = np.searchsorted(words, self.end) - np.searchsorted(words, self.start)
        pair = np.flatnonzero((self.row[1:] == self.row[:-1]) & (count[1:] + count[:-1] >= window_words))
        single = np.flatnonzero(count >= line_words)
        whole = last - first + 1 > 1
        low = np.concatenate([first[whole], pair, single])
        high = np.concatenate([last[whole], pair + 1, single])
        # a chunk of two lines is a window as well
        _, pick = np.unique(low * (len(self.row) + 1) + high - low, return_index=True)
        self.low, self.high = low[pick], high[pick]
        self.is_chunk = pick < whole.sum()
        self.hash = lines.hash

    def hashes(self, block: X.Block) -> tuple[np.ndarray, np.ndarray]:
        h1 = X.span_hash(X.prefix_sums(block.data), self.start[self.low], self.end[self.high])
        size = self.high - self.low + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if not len(size):
            return h1, np.zeros(0, X.U)
        each = X.mixed(self.hash[X.ranges(self.low, size)] + place.astype(X.U) * X.U(0xD1342543DE82EF95))
        return h1, X.mixed(np.add.reduceat(each, np.cumsum(size) - size))


def _found(batches, window_words, line_words):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            units = Units(block, window_words, line_words)
            h1, h2 = units.hashes(block)
            row = units.row[units.low]
            at = pa.array(row + block.first)
            places = [pa.array((x - units.heads[row]).astype(np.int32)) for x in (units.low, units.high)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key_").take(at), *places, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], NAMES)


def _listed(batch, block, heads):
    """(row, first line, last line, place in the list) of the units that the rows' lists name, in lines of the block."""
    asked = batch.column("units").slice(block.first, len(block))
    rows = np.repeat(np.arange(len(block)), np.asarray(asked.value_lengths().fill_null(0)))
    inner = asked.flatten()
    low, high = (np.asarray(inner.field(n)).astype(np.int64) for n in ("low", "high"))
    return rows, low + heads[rows], high + heads[rows], inner


def _bodies(batches, window_words, line_words):
    """The bytes of the units in question; windows and lines within a chunk that stands earlier are left out."""
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            units = Units(block, window_words, line_words)
            rows, low, high, inner = _listed(batch, block, units.heads)
            edge = np.concatenate([[-1], units.chunk, [-1]])
            whole = (units.chunk[low] == units.chunk[high]) & (edge[low] != units.chunk[low]) & (edge[high + 2] != units.chunk[high]) & (high > low)
            hit = np.zeros(len(units.row), bool)  # by chunk
            hit[units.chunk[low[whole & ~np.asarray(inner.field("leads"))]]] = True
            pick = np.flatnonzero(whole | ~(hit[units.chunk[low]] & (units.chunk[low] == units.chunk[high])))
            raw = block.data.tobytes()
            at = pa.array(rows[pick] + block.first)
            take = pa.array(pick)
            # a full Arrow batch of bodies stays as small as a block
            size = np.cumsum(units.end[high[pick]] - units.start[low[pick]])
            cuts = np.searchsorted(size, np.arange(X.BLOCK, int(size[-1]) if len(size) else 0, X.BLOCK))
            bounds = np.unique(np.concatenate([[0], cuts, [len(pick)]]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                body = pa.array([raw[x:y] for x, y in zip(units.start[low[pick[a:b]]].tolist(), units.end[high[pick[a:b]]].tolist(), strict=True)], pa.binary())
                fields = [inner.field(n).take(take[a:b]) for n in ("low", "high", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at[a:b]), batch.column("key_").take(at[a:b]), *fields, body], [*NAMES, "body"])


def repeats(docs: DataFrame, window_words: int = WINDOW_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id_, key_, units): per document the line ranges (low, high) that stand earlier in the corpus."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    unit = UNIT.format(kind=kind)
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", X.row_key().alias("key_"))
    place = F.struct("doc_id_", "key_", "low", "high")
    found = written(keyed.mapInArrow(partial(_found, window_words=window_words, line_words=line_words), unit), "zstd")
    twice = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n_"), F.min(place).alias("first")).where("n_ > 1").drop("n_"))
    named = F.struct("low", "high", "h1", "h2", place.eqNullSafe(F.col("first")).alias("leads"))
    candidates = found.join(twice, ["h1", "h2"]).groupBy("doc_id_", "key_").agg(F.collect_set(named).alias("units"))
    meet = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (keyed["key_"] == candidates["key_"])
    asked = keyed.join(candidates, meet).select("doc_id", "text", keyed["key_"], "units")
    bodies = written(asked.mapInArrow(partial(_bodies, window_words=window_words, line_words=line_words), unit + ", body binary"), "zstd")
    discard(found, twice)
    groups = bodies.groupBy("h1", "h2").agg(F.count("*").alias("n_"), F.min("body").alias("least"), F.max("body").alias("most"), F.min(place).alias("first"))
    confirmed = written(groups.where("n_ > 1 AND least = most").select("h1", "h2", "first"))
    later = bodies.drop("body").join(confirmed, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    # not written: the plan of the last join is then the same at every size
    return later.groupBy("doc_id_", "key_").agg(F.collect_set(F.struct("low", "high")).alias("units"))


def _with_repeats(docs: DataFrame, window_words: int, line_words: int) -> DataFrame:
    known = repeats(docs, window_words, line_words).withColumnRenamed("key_", "found_")
    keyed = docs.withColumn("key_", X.row_key())
    return keyed.join(known, keyed["doc_id"].eqNullSafe(known["doc_id_"]) & (keyed["key_"] == known["found_"]), "left").drop("doc_id_", "found_", "key_")


def _kept(batch):
    """(row, lines, removed lines, removed runs of lines, kept bytes) of every row."""
    for block in X.blocks(batch.column("text")):
        lines = Lines(block)
        heads = np.searchsorted(lines.row, np.arange(len(block) + 1))
        _, low, high, _ = _listed(batch, block, heads)
        out = X.covered(low, high + 1, len(lines.row))
        raw = block.data.tobytes()
        for r in range(len(block)):
            mine = out[heads[r] : heads[r + 1]]
            removed = int(mine.sum())
            text = raw[block.offsets[r] : block.offsets[r + 1]]
            if removed:
                left = np.flatnonzero(~mine) + heads[r]
                text = b"\n".join([raw[a:b] for a, b in zip(lines.start[left].tolist(), lines.end[left].tolist(), strict=True)])
            yield block.first + r, len(mine), removed, len(X.runs(mine)[0]), text


def _report(batches):
    for batch in batches:
        known = np.asarray(batch.column("text").is_valid())
        rows = [(n if known[r] else 0, gone, runs, len(text), hashlib.sha256(text).hexdigest()) for r, n, gone, runs, text in _kept(batch)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_removed", "n_runs", "n_bytes", "kept_sha256"])


def report(docs: DataFrame, window_words: int = WINDOW_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_runs (of removed lines), n_bytes and kept_sha256 of what is left, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _with_repeats(docs.select("doc_id", "text"), window_words, line_words).select("doc_id", "text", "units")
    return joined.mapInArrow(_report, f"doc_id {kind}, n_lines bigint, n_removed bigint, n_runs bigint, n_bytes bigint, kept_sha256 string")


def _rewritten(batches):
    for batch in batches:
        known = np.asarray(batch.column("text").is_valid())
        texts, gone = [], []
        for r, _, removed, _, text in _kept(batch):
            texts.append(text.decode("utf-8", "replace") if known[r] else None)
            gone.append(removed > 0)
        names = [c for c in batch.schema.names if c not in ("text", "units")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array(gone)], [*names, "text", "changed_"])


def dedupe(docs: DataFrame, window_words: int = WINDOW_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """The documents without their repeated lines, with their columns; a document that loses all of its text goes."""
    plain, back = X.neutral(docs, "doc_id", "text")
    joined = _with_repeats(plain, window_words, line_words)
    names = [c for c in joined.columns if c not in ("text", "units")]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", text string, changed_ boolean"
    return back(joined.select(*names, "text", "units").mapInArrow(_rewritten, schema).where("NOT changed_ OR length(text) > 0"))
