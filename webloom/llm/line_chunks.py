"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of two consecutive lines marks boundaries: it is even behind every other line on average, and of
neighbouring marks only the first cuts, so chunks have two lines or more (but for the first and last of a text).  Both rules look at three
lines only, so inserted or removed lines move no boundary beyond their surroundings.

A multi-line chunk that stands more than once in the corpus is kept where it stands first (smallest doc_id, then text hash, then
place) and removed elsewhere.  Candidates meet by two 64-bit hashes on narrow rows; then the bytes of the chunks behind one pair of
hashes are compared, as the smallest and the largest of them, which Spark reduces before it shuffles, however often a chunk stands.

Defined cases: null text stays null and has no lines; an empty text has one empty line; lines end at \\n alone; rows equal in
doc_id and text are one document for the order, so they keep or lose the same chunks; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.llm.tables import discard, written


class Lines:
    """Lines and chunks of the rows of a block."""

    def __init__(self, block: X.Block):
        breaks = np.flatnonzero(block.data == 10)
        rows = np.concatenate([np.arange(len(block)), np.searchsorted(block.offsets, breaks, "right") - 1])
        starts = np.concatenate([block.offsets[:-1], breaks + 1])
        order = np.lexsort((starts, rows))
        self.row, self.start = rows[order], starts[order]
        last = np.concatenate([np.diff(self.row) > 0, [True]])
        self.end = np.where(last, block.offsets[1:][self.row], np.concatenate([self.start[1:], [0]]) - 1)
        sums = X.prefix_sums(block.data)
        self.hash = X.span_hash(sums, self.start, self.end)
        first = np.concatenate([[True], last[:-1]])
        rolled = X.mixed(np.concatenate([[X.U(0)], self.hash[:-1]]) * X.U(0x9E3779B97F4A7C15) + self.hash)
        mark = ((rolled & X.U(1)) == 0) & ~first
        before = np.concatenate([[False], mark[:-1]]) & ~first
        cut = (mark & ~before) | last
        # chunks: lines first..last
        self.last = np.flatnonzero(cut)
        self.first = np.concatenate([[0], self.last[:-1] + 1])
        self.of_row = self.row[self.last]
        opens = np.concatenate([[True], np.diff(self.of_row) > 0])
        heads = np.flatnonzero(opens)
        self.number = np.arange(len(self.last)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(self.last)]])))
        self.low, self.high = self.start[self.first], self.end[self.last]
        self.h1 = X.span_hash(sums, self.low, self.high)
        place = np.arange(len(self.hash)) - np.repeat(self.first, self.last - self.first + 1)
        self.h2 = X.mixed(np.add.reduceat(X.mixed(self.hash + place.astype(X.U) * X.U(0xD1342543DE82EF95)), self.first)) if len(self.first) else np.zeros(0, X.U)
        self.many = self.last > self.first


CHUNK = "doc_id_ {kind}, key_ bigint, chunk int, h1 bigint, h2 bigint"


def _rows(batch, block, lines, pick):
    at = pa.array(lines.of_row[pick] + block.first)
    return [batch.column("doc_id").take(at), batch.column("key_").take(at), pa.array(lines.number[pick].astype(np.int32)), pa.array(lines.h1[pick].view(np.int64)), pa.array(lines.h2[pick].view(np.int64))]


NAMES = ["doc_id_", "key_", "chunk", "h1", "h2"]


def _hashes(batches):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            lines = Lines(block)
            yield pa.RecordBatch.from_arrays(_rows(batch, block, lines, np.flatnonzero(lines.many)), NAMES)


def _wanted(batch, block, lines):
    """Places of the chunks that the row's list names."""
    asked = batch.column("chunks").slice(block.first, len(block))
    size = np.asarray(asked.value_lengths().fill_null(0))
    rows = np.repeat(np.arange(len(block)), size)
    heads = np.searchsorted(lines.of_row, np.arange(len(block)))
    return heads[rows] + np.asarray(asked.flatten()).astype(np.int64)


def _texts(batches):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            lines = Lines(block)
            pick = _wanted(batch, block, lines)
            raw = block.data.tobytes()
            body = pa.array([raw[a:b] for a, b in zip(lines.low[pick].tolist(), lines.high[pick].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*_rows(batch, block, lines, pick), body], [*NAMES, "body"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id_, key_, chunks): per document the numbers of the chunks that stand earlier in the corpus."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", X.row_key().alias("key_"))
    chunk = CHUNK.format(kind=kind)
    found = written(keyed.mapInArrow(_hashes, chunk))
    twice = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_"))
    candidates = found.join(twice, ["h1", "h2"]).groupBy("doc_id_", "key_").agg(F.collect_set("chunk").alias("chunks"))
    meet = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (keyed["key_"] == candidates["key_"])
    bodies = written(keyed.join(candidates, meet).select("doc_id", "text", keyed["key_"], "chunks").mapInArrow(_texts, chunk + ", body binary"), "zstd")
    place = F.struct("doc_id_", "key_", "chunk")
    groups = bodies.groupBy("h1", "h2").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min(place).alias("first"))
    confirmed = written(groups.where("low = high").select("h1", "h2", "first"))
    later = bodies.drop("body").join(confirmed, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    discard(found, twice)
    return later.groupBy("doc_id_", "key_").agg(F.collect_set("chunk").alias("chunks"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    repeats = repeated_chunks(docs).withColumnRenamed("key_", "found_")
    keyed = docs.withColumn("key_", X.row_key())
    return keyed.join(repeats, keyed["doc_id"].eqNullSafe(repeats["doc_id_"]) & (keyed["key_"] == repeats["found_"]), "left").drop("doc_id_", "found_", "key_")


def _kept(batch):
    """(row, lines, removed lines, removed chunks, kept bytes) of every row."""
    for block in X.blocks(batch.column("text")):
        lines = Lines(block)
        gone = _wanted(batch, block, lines)
        out = np.zeros(len(lines.row), bool)
        out[X.ranges(lines.first[gone], lines.last[gone] - lines.first[gone] + 1)] = True
        total = np.bincount(lines.row, minlength=len(block))
        removed = np.bincount(lines.row[out], minlength=len(block))
        chunks = np.bincount(lines.of_row[gone], minlength=len(block))
        raw = block.data.tobytes()
        heads = np.concatenate([[0], np.cumsum(total)])
        for r in range(len(block)):
            if removed[r]:
                mine = np.flatnonzero(~out[heads[r] : heads[r + 1]]) + heads[r]
                text = b"\n".join([raw[a:b] for a, b in zip(lines.start[mine].tolist(), lines.end[mine].tolist(), strict=True)])
            else:
                text = raw[block.offsets[r] : block.offsets[r + 1]]
            yield block.first + r, int(total[r]), int(removed[r]), int(chunks[r]), text


def _report(batches):
    for batch in batches:
        known = np.asarray(batch.column("text").is_valid())
        rows = [(n if known[r] else 0, gone, chunks, len(text), hashlib.sha256(text).hexdigest()) for r, n, gone, chunks, text in _kept(batch)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_removed", "n_chunks", "n_bytes", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (removed), n_bytes and kept_sha256 of what is left, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_repeats(docs.select("doc_id", "text")).select("doc_id", "text", "chunks").mapInArrow(_report, f"doc_id {kind}, n_lines bigint, n_removed bigint, n_chunks bigint, n_bytes bigint, kept_sha256 string")


def _rewritten(batches):
    for batch in batches:
        known = np.asarray(batch.column("text").is_valid())
        texts, gone = [], []
        for r, _, removed, _, text in _kept(batch):
            texts.append(text.decode("utf-8", "replace") if known[r] else None)
            gone.append(removed > 0)
        names = [c for c in batch.schema.names if c not in ("text", "chunks")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array(gone)], [*names, "text", "changed_"])


def dedupe(docs: DataFrame) -> DataFrame:
    """The documents without their repeated chunks, with their columns; a document that loses all of its text goes."""
    plain, back = X.neutral(docs, "doc_id", "text")
    joined = _with_repeats(plain)
    names = [c for c in joined.columns if c not in ("text", "chunks")]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", text string, changed_ boolean"
    return back(joined.select(*names, "text", "chunks").mapInArrow(_rewritten, schema).where("NOT changed_ OR length(text) > 0"))
