"""Exact inner-product search: one ball tree per shard, branch and bound, a shared k-th score.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their id and queries to blocks of at most ``block_rows``, so a task holds
one shard and one block whatever the table size.  Two passes:

1. every shard descends its tree along the best bound only and answers each query from the leaf it ends in; the best of these
   scores over all shards give, per query, a k-th score that the true one cannot fall below;
2. every shard starts with that score as its bar and takes nodes in the order of their upper bound
   ``q.c + |q| r``; a node below the bar is dropped with all it holds, and the bar rises with the shard's own k-th score.

Scores are integer inner products of floor(scale * x), so ties are exact and go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part; a vector
of another length than the query's is no candidate of that query; rows of the same vec_id are separate candidates but never
of a query with that id; a query id that stands twice is answered once, by its smallest vector; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpointed

SCALE = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF = 64


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, v): v = floor(scale * x) of the rows that take part."""
    ok = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(ok).select(F.col(id_column).cast("long").alias("vec_id"), F.size(vector).alias("dims"), whole.alias("v"))


class BallTree:
    """Nodes in arrays; a node covers rows[lo:hi] of the permuted points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.rows, self.points, self.ids = order.copy(), points, ids
        self.lo, self.hi, self.left, self.right, centres, self.radius = [], [], [], [], [], []
        exact = points.astype(np.float64)
        todo = [(0, len(ids), None, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.lo)
            if parent is not None:
                (self.left if side == 0 else self.right)[parent] = node
            part = exact[self.rows[lo:hi]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            self.radius.append(float(away.max()))
            if hi - lo > leaf and away.max() > 0:
                far = part[away.argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                mid = (hi - lo) // 2
                self.rows[lo:hi] = self.rows[lo:hi][np.argpartition(part @ (other - far), mid)]
                todo += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.centres, self.radius = np.array(centres), np.array(self.radius)
        self.points, self.ids = points[self.rows], ids[self.rows]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any point of each node."""
        q = queries.astype(np.float64)
        near = q @ self.centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radius
        return near + 1e-6 * (1 + np.abs(near))  # rounding never hides a tie

    def scores(self, node: int, query: np.ndarray, own: int) -> list[tuple[int, int]]:
        """(score, -id) of a node's points without the query's own row."""
        lo, hi = self.lo[node], self.hi[node]
        found = self.points[lo:hi] @ query
        return [(int(s), -int(i)) for s, i in zip(found, self.ids[lo:hi], strict=True) if i != own]

    def probe(self, query: np.ndarray, own: int, bound: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best of the leaf that the better child leads to."""
        node = 0
        while self.left[node] >= 0:
            a, b = self.left[node], self.right[node]
            node = a if bound[a] >= bound[b] else b
        lo, hi = self.lo[node], min(self.hi[node], self.lo[node] + 4 * LEAF)  # equal points make a leaf of any size
        found = self.points[lo:hi] @ query
        return heapq.nlargest(k, ((int(s), -int(i)) for s, i in zip(found, self.ids[lo:hi], strict=True) if i != own))

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, bar: float) -> list[tuple[int, int]]:
        """All that can be among the k best, given that ``bar`` is no more than the k-th score."""
        best: list[tuple[int, int]] = []
        todo = [(-bound[0], 0)]
        while todo:
            top, node = heapq.heappop(todo)
            if -top < (max(bar, best[0][0]) if len(best) == k else bar):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(todo, (-bound[child], child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            found = self.points[lo:hi] @ query
            high = max(bar, best[0][0]) if len(best) == k else bar
            for at in np.flatnonzero(found >= high):
                row = (int(found[at]), -int(self.ids[lo + at]))
                if -row[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return best


def _answer(k: int, leaf: int, probe: bool):
    def run(key, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(shard) or not len(asked):
            return empty
        tree = BallTree(shard["vec_id"].to_numpy(np.int64), np.stack(shard["v"].to_numpy()).astype(np.int64), leaf)
        queries = np.stack(asked["v"].to_numpy()).astype(np.int64)
        out = []
        for lo in range(0, len(queries), 256):
            for query, own, bar, bound in zip(queries[lo : lo + 256], asked["query_id"][lo : lo + 256], asked["bar"][lo : lo + 256], tree.bounds(queries[lo : lo + 256]), strict=True):
                got = tree.probe(query, own, bound, k) if probe else tree.search(query, own, bound, k, bar)
                out += [(own, -i, s) for s, i in got]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64") if out else empty

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all vectors but its own.

    Both tables as ``quantised`` gives them.
    """
    vectors = checkpointed(vectors)
    asked = queries.groupBy(F.col("vec_id").alias("query_id"), "dims").agg(F.min("v").alias("v"))
    asked = checkpointed(asked)
    shards = vectors.count() // shard_rows + 1
    blocks = asked.count() // block_rows + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("int")))
    # a shard is copied to each block of queries and a block to each shard: that is the work the search asks for
    held = vectors.select("dims", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), every.alias("block"), "vec_id", "v")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(shards - 1).cast("int")))
    keys = ["dims", "shard", "block"]
    schema = "query_id bigint, vec_id bigint, score bigint"

    def ask(bars: DataFrame, probe: bool) -> DataFrame:
        sent = bars.select("dims", spread.alias("shard"), block.alias("block"), "query_id", "v", "bar")
        return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_answer(k, leaf, probe), schema)

    best = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    probed = ask(asked.withColumn("bar", F.lit(float("-inf"))), True)
    kth = probed.groupBy("query_id").agg(F.sort_array(F.collect_list(best)).alias("b")).select("query_id", F.when(F.size("b") >= k, -F.element_at("b", k)["s"]).cast("double").alias("kth"))
    bars = asked.join(kth, "query_id", "left").withColumn("bar", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    found = ask(checkpointed(bars), False)
    # at most k rows per query and shard meet here
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(best)), 1, k).alias("b"))
    return ranked.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
