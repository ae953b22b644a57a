"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document has an expected number of copies: the share of its source, dealt out by odds of the document and at most
``most``.  The whole part of it is certain.  For the rest each document draws a random odds and is ranked, within its source, by
random odds divided by inclusion odds; the ranking is taken from the front until the source's words are reached.

Hot sources: a source is never sorted or gathered.  The rank is cut into bins of about a thousand documents, whole bins are decided by
their sums, and only the bin in which the target falls and the one behind it are looked at document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.tables import discard, written
from webloom.operators.ordinals import numbered

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MOST = 3  # times a document or a source
BIN = 1024  # documents of a bin of the ranking, about
WORD = r"[^\x20\x09-\x0D]+"


def fuller_first(size: str = "size") -> Column:
    """Odds of a document that grow slowly with its words: 1 for the shortest, 4.3 at 20,000 words."""
    return F.log10(F.lit(10.0) + F.col(size))


def levels(items: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, level): where every item takes least(cap, level * mass), the items of a key take its ``total``.

    ``items`` is (key, cap, mass), ``totals`` (key, total) with totals no larger than the sum of caps.  Each round fixes the items that would
    exceed their cap and shares what they leave by mass, until none is above; the driver sees the number of fixed items.
    """
    level, fixed = None, -1
    while True:
        if level is None:
            full = items.withColumn("full_", F.lit(False))
        else:
            full = items.join(level, key).withColumn("full_", F.col("level") * F.col("mass") >= F.col("cap")).drop("level")
        sums = full.groupBy(key).agg(
            F.sum(F.when(F.col("full_"), F.col("cap")).otherwise(0.0)).alias("held_"), F.sum(F.when(F.col("full_"), 0.0).otherwise(F.col("mass"))).alias("mass_"),
            F.sum(F.when(F.col("full_"), F.col("many_")).otherwise(0)).alias("fixed_"),
        )
        left = F.greatest(F.col("total") - F.col("held_"), F.lit(0.0))
        found = written(sums.join(totals, key).select(key, F.when(F.col("mass_") > 0, left / F.col("mass_")).otherwise(F.lit(1e300)).alias("level"), "fixed_"))
        now = found.agg(F.sum("fixed_")).first()[0] or 0
        if level is not None and now == fixed:
            return level
        level, fixed = found.drop("fixed_"), now


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """(row_, doc_id, source, size, u): words and random number of every document; whole texts are read once."""
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.select(
        F.monotonically_increasing_id().alias("row_"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ((F.shiftrightunsigned(drawn, 11) + F.lit(0.5)) / F.lit(float(1 << 53))).alias("u"),
    )


def source_targets(stored: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source_no, source, source_size, target): all words shared out by weight, no source above ``most`` times its own."""
    per = stored.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(per, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int") + 1)
    ranked = written(ranked.withColumn("weight", weight).withColumn("all_", F.lit(0)))
    items = ranked.select("all_", (F.col("source_size") * float(most)).alias("cap"), F.col("weight").alias("mass"), F.lit(1).alias("many_"))
    totals = ranked.groupBy("all_").agg(F.sum("source_size").cast("double").alias("total"))
    level = levels(items, totals, "all_")
    target = F.least(F.col("source_size") * float(most), F.col("level") * F.col("weight"))
    return written(ranked.join(level, "all_").select("source_no", "source", "source_size", target.alias("target")))


def _picked(classes: DataFrame) -> DataFrame:
    """(source_no, q, size, n, k): how many of the n equal documents of the deciding bin are taken, first in rank first, each if it still fits."""
    rows = classes.groupBy("source_no").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("q", "size", "n"))).alias("c"))
    walk = """aggregate(c, struct(gap AS gap, CAST(array() AS array<struct<q: double, size: bigint, n: bigint, k: bigint>>) AS out), (a, x) ->
      aggregate(CAST(array() AS array<int>), CAST(least(x.n, floor(a.gap / x.size)) AS BIGINT), (b, y) -> b, k ->
        struct(a.gap - k * x.size AS gap, array_append(a.out, struct(x.q AS q, x.size AS size, x.n AS n, k AS k)) AS out)))"""
    # one more when its words overshoot by less than what is missing
    over = "array_min(transform(filter(w.out, x -> x.k < x.n AND x.size < 2 * w.gap), x -> struct(x.size AS size, x.q AS q)))"
    rows = rows.withColumn("w", F.expr(walk)).withColumn("more", F.expr(over))
    out = rows.select("source_no", "more", F.explode("w.out").alias("x")).select("source_no", "more", "x.*")
    one = (F.col("more.size") == F.col("size")) & (F.col("more.q") == F.col("q"))
    return out.withColumn("k", F.col("k") + F.when(one, 1).otherwise(0)).drop("more")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, odds: Column | None = None, seed: int = 13) -> DataFrame:
    """(row_, doc_id, source, size, source_size, target, expected, copies, taken), one row per row of ``docs``.

    ``docs`` has doc_id, text and source; other columns do not matter.  ``size`` is the number of words (null text: 0), ``target`` the words the mix is to
    take from the row's source, ``copies`` how often it takes the document, ``taken`` the words of that.  ``odds`` is a column over ``size``
    by which documents of a source differ in their expected copies (equal without it); none has more than ``most`` copies.

    A null source is a source, the last one.  Documents without words take nothing.  Rows equal in doc_id and text draw the same random number and
    are ranked as a class of which any are taken.  An empty table gives an empty result.  The same rows give the same result, in
    any order and partitioning; only which of several equal rows is taken may differ.
    """
    stored = written(sizes(docs, seed))
    sources = source_targets(stored, weights, most)
    rated = stored.join(sources, stored["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rated = written(rated.withColumn("odds_", F.lit(1.0) if odds is None else odds.cast("double")))
    # words of equal odds are dealt out together
    groups = rated.where("size > 0").groupBy("source_no", "odds_").agg(F.sum("size").alias("words"), F.count("*").alias("many_"))
    items = written(groups.select("source_no", (F.col("words") * float(most)).alias("cap"), (F.col("words") * F.col("odds_")).alias("mass"), "many_"))
    level = levels(items, sources.select("source_no", F.col("target").alias("total")), "source_no")
    expected = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("odds_")))
    shared = rated.join(level, "source_no", "left").withColumn("expected", F.coalesce(expected, F.lit(0.0))).drop("level", "odds_")
    # a part closer to a whole number than the arithmetic is none
    shared = shared.withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("part", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    shared = shared.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    # random odds divided by inclusion odds; those that cannot come have no rank
    q = F.when(F.col("part") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("part")) / F.col("part")))
    shared = written(shared.withColumn("q", q).drop("u", "part"))
    discard(stored, rated, items)
    drawn = shared.where("q IS NOT NULL")
    state = shared.groupBy("source_no").agg(
        F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.ceil(F.count("q") / BIN).alias("bins"),
    ).select("source_no", (F.col("target") - F.col("sure")).alias("words"), F.greatest("bins", F.lit(1)).alias("bins"))
    state = written(state)
    place = F.least(F.floor(F.col("q") / (1 + F.col("q")) * F.col("bins")), F.col("bins") - 1)
    binned = drawn.join(state, "source_no").withColumn("bin", place)
    sums = binned.groupBy("source_no", "bin").agg(F.sum("size").alias("in_bin"), F.first("words").alias("words"))
    along = Window.partitionBy("source_no").orderBy("bin")
    # the bin in which the words are reached: all before it are taken whole, it and the next one fill up, none behind them comes
    cut = sums.withColumn("upto", F.sum("in_bin").over(along)).withColumn("behind", F.lead("bin").over(along)).where("upto > words")
    cut = cut.groupBy("source_no").agg(F.min(F.struct("bin", (F.col("words") - F.col("upto") + F.col("in_bin")).alias("gap"), "behind")).alias("m"))
    cut = written(cut.select("source_no", F.col("m.bin").alias("cut"), F.greatest("m.gap", F.lit(0.0)).alias("gap"), F.coalesce("m.behind", "m.bin").alias("behind")))
    deciding = (F.col("bin") == F.col("cut")) | (F.col("bin") == F.col("behind"))
    inside = binned.join(cut, "source_no").where(deciding)
    picks = written(_picked(inside.groupBy("source_no", "q", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))))
    # equal documents of which some are taken: the first of them in any order
    split = picks.where("k > 0 AND k < n").select("source_no", "q", "size")
    none = shared.where(F.lit(False)).select("row_", F.lit(0).cast("bigint").alias("among"))
    if not split.isEmpty():
        rows = numbered(drawn.join(split, ["source_no", "q", "size"], "left_semi").select("row_", "source_no", "q", "size"), ["source_no", "q", "size"], "at_")
        first = rows.groupBy("source_no", "q", "size").agg(F.min("at_").alias("first_"))
        none = rows.join(first, ["source_no", "q", "size"]).select("row_", (F.col("at_") - F.col("first_")).alias("among"))
    out = shared.join(state.drop("words"), "source_no").join(cut.drop("gap"), "source_no", "left").withColumn("bin", place)
    before = F.col("cut").isNull() | (F.col("bin") < F.col("cut"))
    kept = [*out.columns, F.when(F.col("q").isNotNull() & before, 1).otherwise(0).alias("extra")]
    at_cut = (F.col("q").isNotNull() & deciding).eqNullSafe(True)
    chosen = out.where(at_cut).join(picks, ["source_no", "q", "size"]).join(none, "row_", "left")
    chosen = chosen.withColumn("extra", (F.coalesce("among", F.lit(0)) < F.col("k")).cast("int"))
    done = out.where(~at_cut).select(*kept).unionByName(chosen.select(*out.columns, "extra"))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return done.select("row_", "doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as ``mixture`` takes it, with the columns of ``docs``.

    ``docs`` is a stored table, as its rows are met again by their place in the scan.
    """
    copies = mixture(docs, **how).where("copies > 0").select(F.col("row_").alias("mixed_row_"), F.col("copies").alias("mixed_copies_"))
    placed = docs.withColumn("mixed_row_", F.monotonically_increasing_id()).join(copies, "mixed_row_")
    times = F.explode(F.sequence(F.lit(1), F.col("mixed_copies_"))).alias("mixed_copy_")
    return placed.select(*docs.columns, times).select(*docs.columns)
