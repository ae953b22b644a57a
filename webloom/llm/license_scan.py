"""Licence scan with column functions only.

A text is read once for its number of words and once by a gate that asks for the first word of any rule; only texts that pass it are
turned into words.  In those, rules are tried where their first word stands and their keyword follows within ``SPAN`` words.

Overlaps: of several detections that start at one word the one with the highest priority stays, then the longest, then the first rule.
Of the remaining ones, one that lies within an earlier-starting detection of at least its own priority is suppressed.  No
detection is longer than ``SPAN`` words, so each is compared with the ``SPAN`` before it and the work is linear in the hits.

Defined cases: null and empty texts have no words, no labels and score 0; first_word and last_word are null where no base phrase stands;
repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.llm.license_rules import BASE, SPAN, Rule, rules

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HIT = "struct<start:int,end:int,priority:int,confidence:double,label:string>"


def _words(text: Column) -> Column:
    return F.filter(F.split(X.ascii_lower(text), NOT_WORD), lambda w: w != "")


def _base(words: Column) -> Column:
    """Starts of all base phrases, phrase by phrase: array of (start, label)."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def stands(i: Column) -> Column:
            found = F.get(words, i) == parts[0]
            for k in range(1, len(parts)):
                found = found & (F.get(words, i + k) == parts[k])
            return F.coalesce(found, F.lit(False))

        return F.transform(F.filter("starts_", stands), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase, label) for phrase, label in BASE])


def _hits(words: Column, known: list[Rule]) -> Column:
    """The winning detection of every start, in order of place."""
    table: dict[str, list[Column]] = {}
    for order, r in enumerate(known):
        table.setdefault(r.first, []).append(F.struct(F.lit(order).alias("order"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(f"^(?:{r.pattern}) ").alias("pattern")))
    by_first = F.create_map(*[x for first, rows in table.items() for x in (F.lit(first), F.array(*rows))])

    def at(i: Column) -> Column:
        text = F.concat(F.array_join(F.slice(words, i + 1, SPAN), " "), F.lit(" "))
        near = F.filter(by_first[F.get(words, i)], lambda r: F.contains(text, r["keyword"]))
        found = F.transform(near, lambda r: F.struct((-r["priority"]).alias("p"), F.coalesce(-_blanks(F.regexp_substr(text, r["pattern"])), F.lit(0)).alias("n"), r["order"].alias("o"), r["confidence"].alias("confidence"), r["label"].alias("label")))
        best = F.array_min(F.filter(found, lambda h: h["n"] < 0))
        return F.struct(i.alias("start"), (i - best["n"]).alias("end"), (-best["p"]).alias("priority"), best["confidence"].alias("confidence"), best["label"].alias("label"))

    return F.filter(F.transform(F.col("starts_"), at), lambda h: h["end"].isNotNull())


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _unsuppressed(hits: Column) -> Column:
    def stays(h: Column, k: Column) -> Column:
        before = F.slice(hits, F.greatest(k - SPAN, F.lit(0)) + 1, F.least(k, F.lit(SPAN)))
        return ~F.exists(before, lambda e: (e["end"] >= h["end"]) & (e["priority"] >= h["priority"]))

    return F.filter(hits, stays)


def gate(known: list[Rule]) -> str:
    """Matches every text that holds the first word of a rule or of a base phrase."""
    first = sorted({r.first for r in known} | {p.split(" ")[0] for p, _ in BASE})
    return r"(?i)(?<![0-9a-z\x{80}-\x{10FFFF}])(?:" + "|".join(map(re.escape, first)) + r")(?![0-9a-z\x{80}-\x{10FFFF}])"


def scan(docs: DataFrame, known: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections, one row per document."""
    known = rules() if known is None else known
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(text.rlike(gate(known)), text).alias("held_"))
    # the plan branches on the gate: most texts end here
    read = read.withColumn("words_", F.when(F.col("held_").isNotNull(), _words(F.col("held_"))).otherwise(F.array().cast("array<string>"))).drop("held_")
    words = F.col("words_")
    firsts = F.create_map(*[x for f in sorted({r.first for r in known} | {p.split(" ")[0] for p, _ in BASE}) for x in (F.lit(f), F.lit(True))])
    starts = F.filter(F.transform(words, lambda w, i: F.when(firsts[w], i)), lambda i: i.isNotNull())
    read = read.withColumn("starts_", starts)
    read = read.withColumn("base_", F.when(F.size("starts_") > 0, _base(words)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>")))
    read = read.withColumn("hits_", F.when(F.size("starts_") > 0, _hits(words, known)).otherwise(F.array().cast(f"array<{HIT}>")))
    read = read.withColumn("kept_", _unsuppressed(F.col("hits_")))
    base_labels = F.array_sort(F.array_distinct(F.col("base_.label")))
    labels = F.array_sort(F.array_union(F.col("base_.label"), F.col("kept_.label")))
    score = F.greatest(F.coalesce(F.array_max("kept_.confidence"), F.lit(0.0)), F.when(F.size("base_") > 0, 0.5).otherwise(0.0))
    return read.select(
        "doc_id", "n_words", F.size("base_").cast("long").alias("n_base"), F.array_min("base_.start").alias("first_word"), F.array_max("base_.start").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.col("kept_").alias("detections"),
    )
