"""Removal of byte strings that stand more than once, by sorted suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.  Every string of that length (a window) is
tied to one anchor: the place in it whose ``GRAM`` bytes hash lowest, the leftmost of equals.  Equal windows have equal anchors at equal
distances, so windows only need to be compared under one anchor hash.

1. Anchor hashes are counted; windows whose anchor stands once in the corpus are unique.
2. For the others each run of windows with one anchor sends its context (the bytes all its windows cover) to its hash.  Equal
   contexts are reduced to one row before they move.  A hash with more than ``HOT`` places is dealt out by distance from the anchor
   (``STEP`` distances at a time) and by the bytes that all windows at these distances share, so however common a line is, a group is
   only as large as the different contexts of one such core.
3. Within a group the contexts are sorted twice by deep-shallow sorting: as suffixes from the anchor on, and as reversed
   suffixes before it.  Two windows at distance d are equal if their contexts share d bytes backwards and length - d forwards, which the
   neighbours' shared lengths answer for every d.
4. Repeated windows go back to their places and are joined to runs of bytes.

Matches rest on compared bytes; hashes only bring windows together and name contexts.  Strings are judged on the input.

Defined cases: null is the empty text; texts shorter than the length lose nothing by themselves; matches never cross documents; rows equal
in doc_id and text are separate copies, so what is long enough in them goes from all; null doc_ids are ids like any other.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.llm.deep_shallow import sort_suffixes
from webloom.llm.tables import discard, written

LENGTH = 200
GRAM = 40
HOT = 512
STEP = 16
ROWS = 8192
U = np.uint64
LOW = U((1 << 21) - 1)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :])


def _window_runs(block: X.Block, length: int):
    """(row, first window, windows, anchor, anchor hash) of the runs of windows with one anchor; places are in the block."""
    n, reach = len(block.data), X.BLOCK - length
    ends = block.offsets[1:]
    for base in range(0, max(1, n - length + 1), reach):
        data = block.data[base : base + X.BLOCK]
        if len(data) < length:
            continue
        sums = X.prefix_sums(data)
        grams = len(data) - GRAM + 1
        at = np.arange(grams)
        hashes = X.span_hash(sums, at, at + GRAM)
        lowest = _lowest((hashes & ~LOW) | at.astype(U), length - GRAM + 1)[:reach]
        anchor = (lowest & LOW).astype(np.int64)
        row = np.searchsorted(ends, base + np.arange(len(anchor)), "right")
        inside = base + np.arange(len(anchor)) + length <= ends[np.minimum(row, len(ends) - 1)]
        opens = np.ones(len(anchor), bool)
        opens[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(opens)
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        first, count = first[inside[first]], count[inside[first]]
        yield row[first], base + first, count, base + anchor[first], hashes[anchor[first]]


def _anchors(batches, length: int):
    for batch in batches:
        for block in X.blocks(batch.column("text"), X.BLOCK // 2):
            for row, _, _, _, hashes in _window_runs(block, length):
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                cut = np.flatnonzero(new)
                times = np.diff(np.concatenate([cut, [len(row)]]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[cut] + block.first)), pa.array(hashes[cut].view(np.int64)), pa.array(times.astype(np.int32))], ["doc_id", "anchor", "times"])


CONTEXT = "group bigint, name bigint, back int, windows int, body binary, doc_id {kind}, key_ bigint, first bigint"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def _contexts(batches, length: int, hot: int):
    for batch in batches:
        known, keys = batch.column("known"), batch.column("key_")
        for block in X.blocks(batch.column("text"), X.BLOCK // 2):
            raw, sums = block.data.tobytes(), None
            for row, first, count, anchor, hashes in _window_runs(block, length):
                keep, often = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
                cuts = np.searchsorted(row, np.arange(len(block) + 1))
                for r in np.unique(row).tolist():
                    asked = known[block.first + r].values
                    shared, times = asked.field(0).to_numpy().view(U), asked.field(1).to_numpy()
                    order = np.argsort(shared)
                    mine = slice(cuts[r], cuts[r + 1])
                    near = np.minimum(np.searchsorted(shared, hashes[mine], sorter=order), len(shared) - 1)
                    keep[mine] = shared[order][near] == hashes[mine]
                    often[mine] = times[order][near]
                row, first, count, anchor, hashes, often = (v[keep] for v in (row, first, count, anchor, hashes, often))
                if not len(row):
                    continue
                sums = X.prefix_sums(block.data) if sums is None else sums
                back, group = anchor - first, hashes.copy()
                pieces = np.where(often > hot, back // STEP - (back - count + 1) // STEP + 1, 1)
                of = np.repeat(np.arange(len(row)), pieces)
                step = back[of] // STEP - (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                cut = (often > hot)[of]
                far = np.where(cut, np.minimum(back[of], step * STEP + STEP - 1), back[of])  # distances near..far from the anchor
                near = np.where(cut, np.maximum((back - count + 1)[of], step * STEP), (back - count + 1)[of])
                anchor, row, group = anchor[of], row[of], group[of]
                low, high = anchor - far, anchor - near + length
                # what every window at the distances of a step covers, whatever part of the step this run has
                c = np.flatnonzero(cut)
                core = X.span_hash(sums, (anchor - step * STEP)[c], (anchor - step * STEP - (STEP - 1))[c] + length)
                group[c] = X.mixed(group[c] ^ X.mixed(core + step[c].astype(U)))
                name = X.mixed(X.span_hash(sums, low, high) ^ (far * 1024 + near).astype(U))
                # a body once per block; later equal contexts leave it null
                _, once = np.unique(name, return_index=True)
                has = np.zeros(len(name), bool)
                has[once] = True
                for lo in range(0, len(row), ROWS):
                    part = slice(lo, lo + ROWS)
                    bodies = [raw[a:b] if h else None for a, b, h in zip(low[part].tolist(), high[part].tolist(), has[part].tolist(), strict=True)]
                    rows = pa.array(row[part] + block.first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[part].view(np.int64)), pa.array(name[part].view(np.int64)), pa.array(far[part].astype(np.int32)), pa.array((far - near + 1)[part].astype(np.int32)), pa.array(bodies, pa.binary()), batch.column("doc_id").take(rows), keys.take(rows), pa.array(low[part] - block.offsets[row[part]])],
                        CONTEXT_NAMES,
                    )


FOUND = "group bigint, name bigint, back int, windows int, runs array<struct<lo:int,hi:int>>"


def _repeated(batches, length: int):
    """Which windows of each context stand elsewhere too."""
    for table in X.whole_groups(batches, ("group",), ROWS):
        group, back, windows, copies = (table.column(c).to_numpy().astype(np.int64) for c in ("group", "back", "windows", "copies"))
        offsets, data = X.binary_parts(table.column("body"))
        low, high = offsets[:-1], offsets[1:]
        n = len(group)
        order, shared = sort_suffixes(group, data, low + back, high)
        forward_rank = np.empty(n, np.int64)
        forward_rank[order] = np.arange(n)
        forward = shared
        mirrored = data[::-1]
        order, backward = sort_suffixes(group, mirrored, len(data) - low - back, len(data) - low)
        backward_rank = np.empty(n, np.int64)
        backward_rank[order] = np.arange(n)
        hit = np.zeros((n, int(back.max()) + 1), bool)
        for d in range(int(back.max()) + 1):
            rows = np.flatnonzero((back >= d) & (back - windows < d))
            if not len(rows):
                continue
            ahead = np.cumsum(forward < length - d)[forward_rank[rows]]
            behind = np.cumsum(backward < d)[backward_rank[rows]]
            both = ahead * (n + 1) + behind
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            twice = np.zeros(len(rows), bool)
            twice[by[1:]] |= same
            twice[by[:-1]] |= same
            hit[rows, d] = twice | (copies[rows] > 1)
        out = []
        for r in np.flatnonzero(hit.any(axis=1)).tolist():
            inside = hit[r, back[r] - windows[r] + 1 : back[r] + 1][::-1]  # from the first window on
            lo, hi = X.runs(inside)
            out.append((r, [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        if out:
            rows = pa.array([r for r, _ in out])
            kept = [table.column(c).combine_chunks().take(rows) for c in ("group", "name", "back", "windows")]
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for _, x in out], kind)], ["group", "name", "back", "windows", "runs"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id_, found_, spans): per document (id and text hash) the byte spans of its repeated windows, which may overlap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.octet_length("text") >= length).select("doc_id", "text")
    anchors = texts.mapInArrow(partial(_anchors, length=length), f"doc_id {kind}, anchor bigint, times int")
    counts = written(anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1"))
    known = anchors.select("doc_id", "anchor").join(counts, "anchor").groupBy(F.col("doc_id").alias("d_"))
    known = written(known.agg(F.collect_set(F.struct("anchor", "times")).alias("known")))
    joined = texts.join(known, texts["doc_id"].eqNullSafe(known["d_"])).select("doc_id", "text", X.row_key().alias("key_"), "known")
    contexts = written(joined.mapInArrow(partial(_contexts, length=length, hot=hot), CONTEXT.format(kind=kind)), "zstd")
    named = ["group", "name", "back", "windows"]
    different = contexts.groupBy(*named).agg(F.max("body").alias("body"), F.count("*").alias("copies"))
    sorted_ = different.repartition("group").sortWithinPartitions("group")
    found = written(sorted_.mapInArrow(partial(_repeated, length=length), FOUND))
    placed = contexts.drop("body").join(found, named)
    spans = F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"] - 1 + length).alias("hi")))
    rows = placed.select("doc_id", "key_", F.explode(spans).alias("span")).groupBy(F.col("doc_id").alias("doc_id_"), F.col("key_").alias("found_"))
    out = written(rows.agg(F.collect_set("span").alias("spans")))
    discard(counts, known, contexts, found)
    return out


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    spans = repeated_spans(docs, length)
    keyed = docs.withColumn("key_", X.row_key())
    return keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["doc_id_"]) & (keyed["key_"] == spans["found_"]), "left").drop("doc_id_", "found_", "key_")


def _kept(batch):
    """(bytes, removed bytes, removed runs, kept bytes) of every row."""
    spans = batch.column("spans")
    texts = batch.column("text")
    for r in range(batch.num_rows):
        text = texts[r].as_buffer()
        raw = text.to_pybytes() if text is not None else b""
        own = spans[r].values
        if own is None or not len(own):
            yield len(raw), 0, 0, raw
            continue
        gone = X.covered(own.field(0).to_numpy(), own.field(1).to_numpy(), len(raw))
        lo, _ = X.runs(gone)
        yield len(raw), int(gone.sum()), len(lo), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _report(batches):
    for batch in batches:
        rows = [(n, gone, runs, hashlib.sha256(kept).hexdigest()) for n, gone, runs, kept in _kept(batch)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), length).select("doc_id", "text", "spans").mapInArrow(_report, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _rewritten(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        known = np.asarray(batch.column("text").is_valid())
        texts = [kept.decode("utf-8", "ignore") if k else None for k, (_, _, _, kept) in zip(known, _kept(batch), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes, with their columns; characters cut in two go whole."""
    plain, back = X.neutral(docs, "doc_id", "text")
    joined = _with_spans(plain, length)
    names = [c for c in joined.columns if c not in ("text", "spans")]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", text string"
    return back(joined.select(*names, "text", "spans").mapInArrow(_rewritten, schema))
