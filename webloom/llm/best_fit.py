"""Best-fit packing of tokenised documents into sequences, bulk-synchronously.

1. Texts become pieces of at most ``capacity`` tokens; only longer documents are cut.  Pieces are written once, each with its
   rank among the equally long ones of its task.
2. Equal lengths are interchangeable, so documents are kept as runs (length, first rank, count) and gaps as runs (size, first
   sequence, count): at most ``capacity`` lengths whatever the table size.  In each superstep the runs are range-sorted by
   size; every partition sweeps from large to small and gives each document the smallest gap that holds it (its successor), equal ones
   in the order of their ranks, at most one document per gap; what a partition leaves over is swept once more across the
   partitions, which gives the same matches as one sweep over everything.  Gaps shrink, and the next superstep starts.
   Documents longer than half the capacity open sequences of their own; when nothing fits any more, the longest waiting ones open
   as many sequences as their tokens need at least.
3. Each piece looks up the run its rank lies in, in a table whose size depends on the capacity only.

Defined cases: null and empty texts are one piece, the end mark alone; rows with equal or null doc_ids are separate documents; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import tokens
from webloom.session import checkpointed

CAPACITY = 2048
END = b"\0\0\0\0"
TEXTS = 256
Run = tuple[int, int, int]  # size, first rank or sequence, count


def _pieces(batches, path: str, capacity: int, keep: list[str]):
    encoder = tokens.word_tokens(path)
    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        texts = batch.column("text")
        for lo in range(0, batch.num_rows, TEXTS):
            rows, out = [], []
            for r, raw in enumerate(encoder.encode([t or "" for t in texts.slice(lo, TEXTS).to_pylist()]), lo):
                raw += END
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append(r)
                    out.append((k, at // 4, size, zlib.crc32(own), part, seen[size]))
                    seen[size] += 1
            names = ["piece", "start", "length", "ids_crc32", "part_", "rank_"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            own = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in keep], *own], [*keep, *names])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    keep = list(carry)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", piece int, start bigint, length bigint, ids_crc32 bigint, part_ int, rank_ bigint"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(partial(_pieces, path=path, capacity=capacity, keep=keep), schema)


def sweep(items: list[Run], gaps: list[Run]) -> tuple[list[tuple[int, int, int, int, int]], list[Run], list[Run]]:
    """(matches, items left, gaps left); a match is (length, first rank, gap, first sequence, count).

    From large to small; a stack holds the gaps passed so far, the smallest on top.
    """
    stack: list[Run] = []
    matches, left = [], []
    todo = sorted([(-s, 0, f, n) for s, f, n in gaps] + [(-s, 1, f, n) for s, f, n in items])
    for size, kind, first, n in todo:
        if kind == 0:
            stack.append((-size, first, n))
            continue
        while n and stack:
            gap, sequence, room = stack.pop()
            took = min(n, room)
            matches.append((-size, first, gap, sequence, took))
            first, n = first + took, n - took
            if took < room:
                stack.append((gap, sequence + took, room - took))
        if n:
            left.append((-size, first, n))
    return matches, left, stack


def _sweep_part(frames):
    rows = pd.concat(list(frames) or [pd.DataFrame({"size": [], "kind": [], "first": [], "n": []})])
    kinds = {k: [tuple(map(int, x)) for x in g[["size", "first", "n"]].itertuples(index=False)] for k, g in rows.groupby("kind")}
    matches, items, gaps = sweep(kinds.get("item", []), kinds.get("gap", []))
    out = [("match", *m) for m in matches] + [("item", s, f, 0, 0, n) for s, f, n in items] + [("gap", 0, 0, s, f, n) for s, f, n in gaps]
    yield pd.DataFrame(out, columns=["kind", "length", "rank", "gap", "sequence", "n"])


def _distributed_sweep(spark: SparkSession, items: list[Run], gaps: list[Run]):
    rows = [(s, "item", f, n) for s, f, n in items] + [(s, "gap", f, n) for s, f, n in gaps]
    runs = spark.createDataFrame(rows, "size bigint, kind string, first bigint, n bigint").repartitionByRange("size")
    got = runs.mapInPandas(_sweep_part, "kind string, length bigint, rank bigint, gap bigint, sequence bigint, n bigint").collect()
    matches = [(r["length"], r["rank"], r["gap"], r["sequence"], r["n"]) for r in got if r["kind"] == "match"]
    more, items, gaps = sweep([(r["length"], r["rank"], r["n"]) for r in got if r["kind"] == "item"], [(r["gap"], r["sequence"], r["n"]) for r in got if r["kind"] == "gap"])
    return matches + more, items, gaps


def plan(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) from the number of pieces of each length."""
    out, used = [], 0
    items: list[Run] = [(length, 0, n) for length, n in sorted(counts.items())]
    gaps: list[Run] = []

    def opened(length: int, rank: int, n: int) -> Run:
        nonlocal used
        out.append((length, rank, n, used, 0))
        used += n
        return capacity - length, used - n, n

    while items:
        gaps = [g for g in gaps if g[0] > 0]
        smallest = min(items)[0]
        gaps = [g for g in gaps if g[0] >= smallest]
        matches = []
        if gaps:
            matches, items, gaps = _distributed_sweep(spark, items, gaps)
        out += [(length, rank, n, sequence, capacity - gap) for length, rank, gap, sequence, n in matches]
        gaps += [(gap - length, sequence, n) for length, _, gap, sequence, n in matches]
        large = [i for i in items if 2 * i[0] > capacity]
        items = [i for i in items if 2 * i[0] <= capacity]
        gaps += [opened(*i) for i in large]
        if not matches and not large:
            need = -(-sum(s * n for s, _, n in items) // capacity)
            waiting = sorted(items)
            while need > 0 and waiting:
                length, rank, n = waiting.pop()
                took = min(n, need)
                gaps.append(opened(length, rank, took))
                need -= took
                if took < n:
                    waiting.append((length, rank + took, n - took))
            items = waiting
    return out


def _place(batches, lengths, ranks, sequences, offsets):
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank_"))
        at = np.zeros(len(length), np.int64)
        lo, hi = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
        order = np.argsort(length, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            a, b = lo[mine[0]], hi[mine[0]]
            at[mine] = a + np.searchsorted(ranks[a:b], rank[mine], "right") - 1
        names = [c for c in batch.schema.names if c != "rank_"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, path, capacity, carry))
    counts = cut.groupBy("part_", "length").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    shift = checkpointed(counts.withColumn("shift_", F.coalesce(F.sum("n_").over(before), F.lit(0))))
    sizes = {r["length"]: r["n"] for r in shift.groupBy("length").agg(F.sum("n_").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(spark, sizes, capacity)), np.int64).reshape(-1, 5)
    ranked = cut.join(shift.drop("n_"), ["part_", "length"]).withColumn("rank_", F.col("rank_") + F.col("shift_")).select(*carry, "piece", "start", "length", "ids_crc32", "rank_")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(partial(_place, lengths=rows[:, 0], ranks=rows[:, 1], sequences=rows[:, 3], offsets=rows[:, 4]), schema)
