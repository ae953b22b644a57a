"""N-gram Jaccard join with a prefix tree, and the classes it links.

1. Every text becomes a set of n-grams; equal sets are one class from here on, so exact copies meet nobody.
2. Classes that share hardly any of the least members of 24 bins with another class are done.  Of the rest, each
   class's prefix keys (``ngram_sets``) are counted; only those that two classes share, and enough of them in a part, matter.
3. Classes are sent to their keys, small sets whole, large ones part by part, with members cut to 16 bits: a cut
   member can only be taken for another one, so an overlap is never underrated.  A key with more than ``GROUP`` classes is
   cut into blocks, and each pair of blocks is a group of its own, so a task holds two blocks at most.
4. Each group is joined in a prefix tree (``prefix_trie``).  That gives candidates, which are checked on the whole sets
   with whole members afterwards.  Large groups report a spanning forest of what they found first; once its links are joined into
   components, they are joined again for candidates between different components.  So a family of thousands of similar texts
   costs rows in proportion to its size, and no link between components is lost.
5. Components of the links, by ``components``.

The order of members is by hash with the most common members of a bounded sample of documents (``SAMPLE`` documents, ``COMMON``
members) behind the others; it decides the work only, never the result.  Members are 63-bit hashes and classes 64-bit ones.

Defined cases: null and empty texts and texts of blanks have the empty set, which is linked with nothing; fewer words than n are
one member; rows of one doc_id are separate texts; a null doc_id is no component id unless all of the component's are null.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import ngram_sets as N
from webloom.llm import prefix_trie
from webloom.llm import textops as X
from webloom.llm.components import components
from webloom.llm.tables import discard, written

SAMPLE = 8000
COMMON = 50_000
GROUP = 512
SMALL = 32
CUT = "<u2"  # members as they are sent
ROWS = 1024
KEYS = ("group", "low", "high")
U = np.uint64


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(batches, n: int):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(N.gram_sets(block, n)[0]))], ["member"])


def common_members(docs: DataFrame, n: int, sample: int = SAMPLE, most: int = COMMON) -> np.ndarray:
    """The members that stand most often in a bounded sample of documents, ascending."""
    total = docs.count()
    scale = 1 << 30
    rate = min(scale, scale * sample // total) if total else 0
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(scale)) < rate).select("text")
    counts = drawn.mapInArrow(partial(_grams, n=n), "member bigint").groupBy("member").agg(F.count("*").alias("n_")).where("n_ > 2")
    top = counts.orderBy(F.desc("n_"), "member").limit(most).select("member").toArrow()
    return np.sort(top.column("member").combine_chunks().to_numpy().view(U)) if top.num_rows else np.zeros(0, U)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_signed(values)))


def _signatures(batches, n: int, num: int, den: int):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            members, bounds = N.gram_sets(block, n)
            rows = slice(block.first, block.first + len(block))
            own = [pa.array(_signed(N.set_id(members, bounds))), pa.array(np.diff(bounds)), _lists(*N.minima(members, bounds, num, den))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("key_")[rows], *own], ["doc_id", "key_", "node", "size", "bins"])


def _keys(batches, n: int, num: int, den: int, common: np.ndarray):
    for batch in batches:
        for block in X.blocks(batch.column("text")):
            members, bounds = N.gram_sets(block, n)
            members = N.ordered(members, common)
            found = [N.keys(members[a:b], num, den) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in found])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[block.first : block.first + len(block)], _lists(np.concatenate(found), ends)], ["doc_id", "keys"])


SENT = "group bigint, low int, high int, side int, level int, node bigint, size bigint, large boolean, body binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]
SENT_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _send(batches, n: int, num: int, den: int, common: np.ndarray, group: int):
    for batch in batches:
        known = batch.column("known")
        for block in X.blocks(batch.column("text"), X.BLOCK // 4):
            members, bounds = N.gram_sets(block, n)
            nodes = _signed(N.set_id(members, bounds)).tolist()
            members, out, held = N.ordered(members, common), [], 0
            for r in range(len(block)):
                mine = members[bounds[r] : bounds[r + 1]]
                asked = known[block.first + r].values
                shared, counts = asked.field(0).to_numpy().view(U), asked.field(1).to_numpy()
                order = np.argsort(shared)
                shared, counts = shared[order], counts[order]
                found = False
                for level in N.levels(len(mine), num, den) if len(mine) else []:
                    placed, cuts, keys, part = N.keyed(mine, level, num, den)
                    near = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                    to = np.flatnonzero(N.sent(shared[near] == keys, part, np.diff(cuts), num, den))
                    bodies = {}
                    for k in to.tolist():
                        p = int(part[k])
                        if p not in bodies:
                            bodies[p] = X.mixed(placed[cuts[p] : cuts[p + 1]]).astype(CUT).tobytes()
                        count, own = int(counts[near[k]]), int(keys[k].view(np.int64))
                        blocks = -(-count // group)
                        b = nodes[r] % blocks
                        for other in range(blocks):
                            side = -1 if other == b else int(b > other)
                            out.append((own, min(b, other), max(b, other), side, level, nodes[r], int(cuts[p + 1] - cuts[p]), count > SMALL, bodies[p]))
                            held += len(bodies[p])
                    found |= len(to) > 0
                if found:  # candidates are checked on the whole set
                    out.append((nodes[r], -1, -1, 0, -1, nodes[r], len(mine), False, (mine & ~N.TOP).tobytes()))
                    held += 8 * len(mine)
                if held > X.BLOCK:
                    yield _record(out, SENT_NAMES, SENT_KINDS)
                    out, held = [], 0
            if out:
                yield _record(out, SENT_NAMES, SENT_KINDS)


def _record(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


FOUND = SENT + ", a bigint, b bigint"


def _join(batches, num: int, den: int, again: bool):
    """Pairs (a, b); the first time also the sets and, for the second, the rows of large groups."""
    nothing = lambda n: [pa.nulls(n, pa.int64())] * 2
    for table in X.whole_groups(batches, KEYS, ROWS):
        level = table.column("level").to_numpy()
        if not again:
            kept = table.filter(pa.array((level < 0) | np.asarray(table.column("large").combine_chunks()))).combine_chunks()
            for batch in kept.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, *nothing(batch.num_rows)], [*SENT_NAMES, "a", "b"])
            table = table.filter(pa.array(level >= 0)).combine_chunks()
            level = level[level >= 0]
        if not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in KEYS])
        group = np.cumsum(np.concatenate([[True], (np.diff(keys) != 0).any(axis=0)])) - 1
        node, size, side = (table.column(c).to_numpy() for c in ("node", "size", "side"))
        component = table.column("component").to_numpy() if again else node
        large = np.asarray(table.column("large").combine_chunks())
        offsets, data = X.binary_parts(table.column("body"))
        members = np.frombuffer(data.tobytes(), CUT).astype(U)
        a, b = prefix_trie.similar_pairs(group, size, component, side, members, offsets // 2, num, den)
        if not again:
            keep = ~large[a]
            for g in np.unique(group[a[large[a]]]):
                mine = np.flatnonzero(large[a] & (group[a] == g))
                keep[mine] = prefix_trie.forest(node[a[mine]], node[b[mine]])
            a, b = a[keep], b[keep]
        if len(a):
            empty = [pa.nulls(len(a), kind) for kind in SENT_KINDS]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], [*SENT_NAMES, "a", "b"])


def _met(rows: DataFrame, num: int, den: int, again: bool) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(partial(_join, num=num, den=den, again=again), FOUND)


def _checked(batches, num: int, den: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * common >= num * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _true_links(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar, each once."""
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("body").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("body").alias("set_b")), "b")
    return both.mapInArrow(partial(_checked, num=num, den=den), "a bigint, b bigint").distinct()


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, group: int = GROUP) -> DataFrame:
    """(doc_id, key_, node, size, component_id), one row per document: text hash, set class, set size, smallest doc_id of the component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    common = common_members(texts, n)
    signed = written(texts.withColumn("key_", X.row_key()).mapInArrow(partial(_signatures, n=n, num=num, den=den), f"doc_id {kind}, key_ bigint, node bigint, size bigint, bins array<bigint>"))
    classes = written(signed.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first")))
    # one document per class; repeated rows of it meet again as one class
    head = classes.select(F.col("first").alias("doc_id"), F.col("node").alias("n_"))
    alone = signed.join(head, signed["doc_id"].eqNullSafe(head["doc_id"]) & (signed["node"] == head["n_"])).select(signed["doc_id"], "size", "bins")
    bins = alone.select("doc_id", F.explode("bins").alias("bin"))
    twice = written(bins.groupBy("bin").agg(F.count("*").alias("n_")).where("n_ > 1").select("bin"))
    near = bins.join(twice, "bin").groupBy("doc_id").agg(F.count("*").alias("n_")).where(F.col("n_") >= N.SHARED).select("doc_id")
    near = near.unionByName(alone.where(F.col("size") < N.BINNED).select("doc_id")).distinct().withColumnRenamed("doc_id", "d_")
    kept = written(texts.join(near, texts["doc_id"].eqNullSafe(near["d_"])).select("doc_id", "text"), "zstd")
    keyed = written(kept.mapInArrow(partial(_keys, n=n, num=num, den=den, common=common), f"doc_id {kind}, keys array<bigint>"))
    keys = keyed.select("doc_id", F.explode("keys").alias("key"))
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1"))
    known = written(keys.join(counts, "key").groupBy(F.col("doc_id").alias("d_")).agg(F.collect_set(F.struct("key", "n_")).alias("known")))
    narrow = written(signed.drop("bins"))
    discard(signed, twice, keyed, counts)
    rows = kept.join(known, kept["doc_id"].eqNullSafe(known["d_"])).select("text", "known")
    sent = rows.mapInArrow(partial(_send, n=n, num=num, den=den, common=common, group=group), SENT)
    found = written(_met(sent, num, den, False))
    discard(known, kept)
    sets = found.where("level = -1").select("node", "body")
    links = written(_true_links(found, sets, num, den))
    roots = components(links)
    more = found.where("level >= 0").drop("a", "b").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    links = links.unionByName(written(_true_links(_met(more.select(*SENT_NAMES, "component"), num, den, True), sets, num, den)))
    roots = written(components(links))
    firsts = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = written(firsts.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(firsts.join(lowest, "root").select("node", "component_id"))
    discard(found, classes, lowest)
    out = narrow.join(named, "node", "left")
    empty: Column = F.col("size") == 0
    return out.select("doc_id", "key_", "node", "size", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, with their columns, without all but the first of each component of similar texts.

    Of rows equal in doc_id and text all stay or go; empty texts stay.
    """
    gone = linked(docs, n, num, den).where("size > 0 AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_"), F.col("key_").alias("gone_key_")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_"]) & (F.xxhash64(docs["text"]) == gone["gone_key_"]), "left_anti")
