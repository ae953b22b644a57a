"""Prefix trie of conversations from sorted sequences: every node is an interval of the sorted order.

Conversations are sorted by their sequences of turns; neighbours' longest common prefixes (LCPs), counted in turns, hold the whole trie.  A
candidate prefix (conversation, depth) binary-searches the left and the right end of its interval by range minima of the LCPs from a
sparse table, each candidate for itself; a second table gives the smallest conversation of the interval, and the candidate of that one is the
node.  Subtrees are runs of the nodes in preorder, so their sums are differences of running sums.

Across tasks: the sorted order is cut into shards of about ``SHARD`` turns, in which runs of equal sequences are cut by conv_id, so a prefix shared by a third
of all conversations is many pieces.  A piece that reaches over a shard's edge finds the first and the last shard of its node by the same search over the shards'
own minima, two numbers a shard, and pieces of one node are added up.  What no other conversation has is never sorted: from the first turn that
stands in one conversation only, a conversation is a chain of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.tables import discard, written
from webloom.llm.textops import ranges

SHARD = 200_000  # turns and conversations of a shard, about
RUN = 4096  # depths listed at a time
DIGEST = 16  # bytes of a turn's SHA-256 that stand for it
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, points): the turns in order from 1, each as the hash of role and text and the code points of its text.

    Null role and text are empty, rows without conv_id take no part.  Order: turn, nulls first; equal turns by hash.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    narrow = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST).alias("digest"), F.length(text).cast("bigint").alias("points"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return narrow.select(F.col("conv_id").cast("bigint"), F.row_number().over(order).cast("bigint").alias("place"), "digest", "points")


def rebuilt(placed: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """((conv_id, total), (conv_id, place, digest, points)): conversations that share openings, for trials of the trie.

    Conversation c starts with the first h turns of conversation c - c % group (all if fewer, none if absent), h = crc32(c) % (most + 1), and goes
    on with its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    opening = placed.where((F.col("conv_id") % group == 0) & (F.col("place") <= most)).groupBy(F.col("conv_id").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "points"))).alias("all_"))
    shape = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("anchor", F.col("conv_id") - F.col("conv_id") % group)
    shape = shape.join(opening, "anchor", "left").withColumn("opening", F.slice(F.coalesce("all_", F.array().cast(opening.schema["all_"].dataType)), F.lit(1), F.col("h").cast("int")))
    shape = written(shape.select("conv_id", "h", "opening", F.size("opening").cast("bigint").alias("m"), (F.size("opening") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("total")))
    given = shape.select("conv_id", F.explode("opening").alias("o")).select("conv_id", "o.*")
    own = placed.join(shape.select("conv_id", "h", "m"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "digest", "points")
    return shape.select("conv_id", "total"), given.unionByName(own)


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minima of 2**k values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def minima_of(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of the values from first to last, both included, per query."""
    size = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for k in np.unique(size).tolist():
        at = size == k
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << k) + 1])
    return out


def reach_right(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place r such that all values behind ``start`` up to r are at least ``depth``."""
    at, end = start.astype(np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        ahead = np.flatnonzero(at + (1 << k) <= end)
        ahead = ahead[levels[k][at[ahead] + 1] >= depth[ahead]]
        at[ahead] += 1 << k
    return at


def reach_left(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place l such that all values behind l up to ``start`` are at least ``depth``."""
    at = start.astype(np.int64)
    for k in range(len(levels) - 1, -1, -1):
        back = np.flatnonzero(at >= 1 << k)
        back = back[levels[k][at[back] - (1 << k) + 1] >= depth[back]]
        at[back] -= 1 << k
    return at


def common_prefixes(starts: np.ndarray, lengths: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Per sequence the number of turns it shares from the start with the one before; -1 for the first."""
    out = np.full(len(lengths), -1, np.int64)
    shorter = np.minimum(lengths[:-1], lengths[1:])
    out[1:] = shorter
    pair = np.repeat(np.arange(len(shorter)), shorter)
    left, right = ranges(starts[:-1], shorter), ranges(starts[1:], shorter)
    differ = np.flatnonzero((turn[left] != turn[right]).any(axis=1))
    pairs, first = np.unique(pair[differ], return_index=True)
    out[pairs + 1] = left[differ[first]] - starts[pairs]
    return out


_PIECE = (
    "kind int, depth bigint, first_shard bigint, last_shard bigint, parent_shard bigint, shard bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, points bigint, total bigint, ends string"
)
NODE, OPEN, ENDS, TAIL = range(4)  # kinds of rows: whole node, piece of a node that reaches over an edge, its ended conversations, start of a private chain


def _pieces(kind: int, **columns) -> pa.Table:
    names = [c.split()[0] for c in _PIECE.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = {"kind": pa.array(np.full(n, kind, np.int32))} | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}
    types = {"kind": pa.int32(), "ends": pa.string()}
    return pa.table({c: (arrays[c] if c in arrays else pa.nulls(n)).cast(types.get(c, pa.int64())) for c in names})


def _maskable(values: np.ndarray, shown: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~shown)


def _intervals(shards: list[tuple[int, int, int]]):
    """The trie of one shard; ``shards`` has (number, LCP of its first and last sequence, LCP of its last one and the next shard's first) in order."""
    position = {s[0]: k for k, s in enumerate(shards)}

    def trie(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("place")
        here = position[key[0].as_py()]
        flat = [v for s in shards for v in s[1:]][:-1]  # inner, edge, inner, edge, ... inner
        edges = range_minima(np.asarray(flat, np.int64))
        conv, tail, total = (rows.column(c).to_numpy() for c in ("conv_id", "tail", "total"))
        held = rows.column("digests").combine_chunks()
        offsets = held.offsets.to_numpy().astype(np.int64)
        starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        flat_turns = held.flatten()
        turn = np.frombuffer(b"".join(flat_turns.to_pylist()), np.uint64).reshape(-1, 2)
        points = rows.column("points").combine_chunks().flatten().to_numpy()
        n = len(conv)
        lcp = common_prefixes(starts, lengths, turn)
        levels, smallest = range_minima(lcp), range_minima(conv)

        # every prefix of every sequence searches both ends; the smallest conversation's candidate is the node
        row, depth = np.repeat(np.arange(n), lengths + 1), ranges(np.zeros(n, np.int64), lengths + 1)
        left, right = reach_left(levels, row, depth), reach_right(levels, row, depth)
        own = conv[row] == minima_of(smallest, left, right)
        order = np.lexsort((depth[own], left[own]))
        left, right, depth, member = (a[own][order] for a in (left, right, depth, conv[row]))
        first_node = np.zeros(n + 1, np.int64)  # in preorder, of the nodes that start at a row
        np.cumsum(lengths - lcp, out=first_node[1:])

        def node_of(at: np.ndarray, level: np.ndarray) -> np.ndarray:
            begin = reach_left(levels, at, level)
            return first_node[begin] + level - lcp[begin] - 1

        n_nodes = len(depth)
        parent = np.full(n_nodes, -1, np.int64)
        inner = np.flatnonzero(depth > 0)
        parent[inner] = node_of(left[inner], depth[inner] - 1)
        last = node_of(np.arange(n), lengths)
        tails = np.bincount(last[tail], minlength=n_nodes)
        before = flat[2 * here - 1] if here else -1
        behind = flat[2 * here + 1] if here + 1 < len(shards) else -1
        to_left, to_right = (left == 0) & (depth <= before), (right == n - 1) & (depth <= behind)
        is_open = to_left | to_right
        shut = ~is_open
        children = np.bincount(parent[inner][shut[inner]], minlength=n_nodes) + tails
        size = right - left + 1
        last_points = np.zeros(n_nodes, np.int64)
        last_points[inner] = points[starts[left[inner]] + depth[inner] - 1]
        upto_leaves, upto_saved = np.zeros(n_nodes + 1, np.int64), np.zeros(n_nodes + 1, np.int64)
        np.cumsum((shut & (children == 0)) + tails, out=upto_leaves[1:])
        np.cumsum(shut * (size - 1) * last_points, out=upto_saved[1:])
        end = first_node[right + 1]
        leaves, saved = upto_leaves[end] - upto_leaves[:-1], upto_saved[end] - upto_saved[:-1]

        # the shards in which the nodes that reach over an edge begin and end
        first_shard, last_shard = np.full(n_nodes, here), np.full(n_nodes, here)
        if here:
            at = np.flatnonzero(to_left)
            first_shard[at] = (reach_left(edges, np.full(len(at), 2 * here - 1), depth[at]) + 1) // 2
        if behind >= 0:
            at = np.flatnonzero(to_right)
            last_shard[at] = (reach_right(edges, np.full(len(at), 2 * here + 1), depth[at]) + 1) // 2

        # ended conversations per node, which stand in order of conv_id
        ended = np.flatnonzero(~tail)
        ended = ended[np.argsort(last[ended], kind="stable")]
        cuts = np.flatnonzero(np.diff(last[ended])) + 1
        lists = {int(last[g[0]]): ",".join(map(str, conv[g].tolist())) for g in np.split(ended, cuts) if len(g)}
        at = np.flatnonzero(shut)
        hashes = [hashlib.sha256(lists[k].encode()).hexdigest() if k in lists else NOTHING for k in at.tolist()]
        above = np.maximum(parent, 0)
        parent_open = (parent >= 0) & is_open[above]
        parent_shut = (parent >= 0) & shut[above]
        out = [
            _pieces(
                NODE, depth=depth[at], conv_id=member[at], parent_conv_id=_maskable(member[above][at], parent_shut[at]), parent_shard=_maskable(first_shard[above][at], parent_open[at]),
                n_convs=size[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at], ends=pa.array(hashes, pa.string()),
            )
        ]
        at = np.flatnonzero(is_open)
        out.append(
            _pieces(
                OPEN, depth=depth[at], first_shard=first_shard[at], last_shard=last_shard[at], parent_shard=_maskable(first_shard[above][at], parent_open[at]), shard=np.full(len(at), here),
                conv_id=member[at], n_convs=size[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at], points=last_points[at],
            )
        )
        at = np.asarray([k for k in at.tolist() if k in lists], np.int64)
        out.append(_pieces(ENDS, depth=depth[at], first_shard=first_shard[at], shard=np.full(len(at), here), ends=pa.array([lists[k] for k in at.tolist()], pa.string())))
        at = np.flatnonzero(tail)
        ends_in = last[at]
        out.append(
            _pieces(
                TAIL, depth=lengths[at], conv_id=conv[at], total=total[at], parent_conv_id=_maskable(member[ends_in], shut[ends_in]),
                parent_shard=_maskable(first_shard[ends_in], is_open[ends_in]),
            )
        )
        return pa.concat_tables(out)

    return trie


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids of a node, shard after shard -> the hash of the whole list; nothing is kept but the hash."""
    node, digest = None, None
    for batch in batches:
        out = []
        for first, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("first_shard", "depth", "ends")], strict=True):
            if (first, depth) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (first, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _hashes(out)
    if node is not None:
        yield _hashes([(*node, digest.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["first_shard", "depth", "ends_sha256"])


def _subtrees(nodes: pa.Table) -> pa.Table:
    """Sums over the subtrees of the nodes that reach over edges; a subtree is a run in the order (first shard, depth)."""
    nodes = nodes.combine_chunks().sort_by([("first_shard", "ascending"), ("depth", "ascending")])
    first, last = nodes.column("first_shard").to_numpy(), nodes.column("last_shard").to_numpy()
    end = np.searchsorted(first, last, "left")
    for name in ("n_leaves", "saved_tokens"):
        upto = np.concatenate([[0], np.cumsum(nodes.column(f"own_{name}").to_numpy())])
        total = nodes.column(name).to_numpy() + upto[end] - upto[:-1]
        nodes = nodes.set_column(nodes.column_names.index(name), name, pa.array(total, pa.int64()))
    return nodes


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(members: DataFrame, rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per distinct prefix.

    ``members`` is (conv_id, total) with one row per conversation, ``rows`` (conv_id, place, digest, points) its turns, places 1 to total without gaps.
    A node is named by its smallest member and its depth; the root has depth 0 and a null parent.  ``n_leaves`` and ``saved_tokens`` count over
    the subtree, the node included; ``ends_sha256`` hashes the ids of the conversations that end in the node.

    No conversations give no rows; conversations without turns are members of the root.  Equal conversations share all nodes.  Turns are compared by 128 bits of
    SHA-256.  Memory of a task: a shard, or the longest opening that a conversation shares with another one (24 bytes a turn).
    """
    rows = written(rows)
    # a turn that stands at its depth in one conversation only begins a part that nobody shares
    alone = rows.groupBy("place", "digest").agg(F.count("*").alias("n_"), F.min("conv_id").alias("conv_id")).where("n_ = 1").groupBy("conv_id").agg((F.min("place") - 1).alias("alone_"))
    shape = members.join(alone, "conv_id", "left").select("conv_id", "total", F.coalesce("alone_", "total").alias("shared"), F.col("alone_").isNotNull().alias("tail"))
    shape = written(shape)
    common = rows.join(shape.where("shared > 0").select("conv_id", "shared"), "conv_id").where("place <= shared")
    sequences = common.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "points"))).alias("s"))
    sequences = shape.join(sequences, "conv_id", "left").select(
        "conv_id", "total", "tail", F.coalesce("s.digest", F.array().cast("array<binary>")).alias("digests"), F.coalesce("s.points", F.array().cast("array<bigint>")).alias("points"),
    )
    many = shape.agg(F.sum(F.col("shared") + 1)).first()[0] or 0
    ordered = sequences.repartitionByRange(max(1, -(-many // shard)), "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id())).withColumn("shard", F.shiftright("place", 33))
    discard(rows)
    ends = ordered.groupBy("shard").agg(F.min_by("digests", "place").alias("a"), F.max_by("digests", "place").alias("z"))
    shorter = "least(size({0}), size({1}))"
    same = f"coalesce(nullif(array_position(zip_with(slice({{0}}, 1, {shorter}), slice({{1}}, 1, {shorter}), (x, y) -> x <> y), true), 0) - 1, {shorter})"
    ends = ends.withColumn("next", F.lead("a").over(Window.orderBy("shard")))  # a row per shard
    listed = ends.selectExpr("shard", f"CAST({same.format('a', 'z')} AS BIGINT)", f"CAST(coalesce({same.format('z', 'next')}, -1) AS BIGINT)").orderBy("shard").collect()
    found = written(ordered.groupBy("shard").applyInArrow(_intervals([tuple(r) for r in listed]), _PIECE))

    parts = found.where(F.col("kind") == OPEN).groupBy("first_shard", "depth").agg(
        F.first("last_shard").alias("last_shard"), F.first("parent_shard").alias("parent_shard"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    parts = written(parts)
    below = parts.where("depth > 0").groupBy(F.col("parent_shard").alias("first_shard"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("open_children"))
    wide = parts.join(below, ["first_shard", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("open_children")
    wide = wide.withColumn("own_n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("own_saved_tokens", (F.col("n_convs") - 1) * F.col("points"))
    # as many as the openings that neighbouring shards share have turns
    summed = wide.groupBy(F.lit(0).alias("all_")).applyInArrow(_subtrees, wide.schema)
    hashes = found.where(F.col("kind") == ENDS).select("first_shard", "depth", "shard", "ends").repartition("first_shard", "depth").sortWithinPartitions("first_shard", "depth", "shard")
    hashes = hashes.mapInArrow(_ends, "first_shard bigint, depth bigint, ends_sha256 string")
    open_nodes = written(summed.join(hashes, ["first_shard", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    parents = open_nodes.select(F.col("first_shard").alias("parent_shard"), F.col("depth").alias("above_"), F.col("conv_id").alias("open_parent_"))

    def with_parent(df: DataFrame, depth: str) -> DataFrame:
        joined = df.join(parents, (df["parent_shard"] == parents["parent_shard"]) & (F.expr(depth) == F.col("above_")), "left")
        return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent_"))

    shared_nodes = with_parent(found.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256"), "depth - 1").select(*_NODE)
    edge_nodes = with_parent(open_nodes.withColumn("parent_conv_id", F.lit(None).cast("bigint")), "depth - 1").select(*_NODE)

    def chain(df: DataFrame) -> DataFrame:
        one = {c: F.lit(1).cast("bigint").alias(c) for c in ("n_convs", "n_leaves")}
        last = F.col("depth") == F.col("total")
        hashed = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
        return df.select("conv_id", "depth", "parent_conv_id", one["n_convs"], F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one["n_leaves"], F.lit(0).cast("bigint").alias("saved_tokens"), hashed.alias("ends_sha256"))

    starts = chain(with_parent(found.where(F.col("kind") == TAIL), "depth").withColumn("depth", F.col("depth") + 1))
    onward = shape.where("tail AND shared + 2 <= total").select("conv_id", "total", F.explode(F.sequence(F.col("shared") + 2, F.col("total"), F.lit(RUN))).alias("from_"))
    onward = onward.select("conv_id", "total", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + RUN - 1, F.col("total")))).alias("depth"))
    return shared_nodes.unionByName(edge_nodes).unionByName(starts).unionByName(chain(onward.withColumn("parent_conv_id", F.col("conv_id"))))


def report(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The prefix trie of the conversations rebuilt by ``rebuilt``."""
    members, rows = rebuilt(written(turns(conversations)))
    return trie(members, rows, shard)
