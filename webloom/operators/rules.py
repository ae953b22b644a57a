"""A table of glob rules joined with URLs, each pair found by a piece of text that both must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.sqltext import in_memory, lit
from webloom.operators.skew import salted_join
from webloom.session import checkpointed

GRAM = 4  # characters of a piece that may stand anywhere

_TOKENS = f"regexp_extract_all(pattern, {lit(r'(?s)\[!?\]?[^\]]*\]|.')}, 0)"
_CLASS = (
    f"concat('[', regexp_replace(regexp_replace(regexp_replace(substr(t, 2, length(t) - 2), {lit(r'[\\\[]')}, {lit(r'\\$0')}), '^\\\\^', {lit(r'\\^')}), '^!', '^'), ']')"
)
_LITERAL = f"IF(t RLIKE {lit(r'^[A-Za-z0-9_/:&=%~@,; ]$')}, t, concat({lit(chr(92))}, t))"
# the text of a glob between its wildcards; the first piece is what every match starts with
_PIECES = f"split(regexp_replace(pattern, {lit(r'(?s)\[!?\]?[^\]]*\]|[*?]')}, chr(0)), chr(0), -1)"


def rule_patterns(rules: DataFrame) -> DataFrame:
    """``rules`` (rule_no, pattern) with ``regex``, the shell pattern as an anchored regular expression."""
    body = f"transform({_TOKENS}, t -> CASE WHEN t = '*' THEN '.*' WHEN t = '?' THEN '.' WHEN length(t) > 1 THEN {_CLASS} ELSE {_LITERAL} END)"
    return rules.withColumn("regex", F.expr(f"concat('(?s)^(?:', array_join({body}, ''), ')$')"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """``rules`` with ``key``: of the pieces a match must hold, the one that the fewest rules share.

    A key is ``^`` and the text that matches start with, ``~`` and a few characters that stand somewhere in them, or nothing for a rule without text.
    """
    grams = (
        f"flatten(transform(p, s -> IF(length(s) = 0, CAST(array() AS array<string>), "
        f"transform(sequence(1, greatest(length(s) - {GRAM - 1}, 1)), k -> concat('~', substr(s, k, {GRAM}))))))"
    )
    pieces = rules.withColumn("p", F.expr(_PIECES))
    offered = F.expr(f"array_distinct(concat(IF(length(p[0]) > 0, array(concat('^', p[0])), CAST(array() AS array<string>)), {grams}, array('')))")
    pairs = pieces.select("rule_no", F.explode(offered).alias("key"))
    counts = pairs.where("key <> ''").groupBy("key").agg(F.count("*").alias("n_"))
    # no text at all is the last choice
    ranked = pairs.join(counts, "key", "left").groupBy("rule_no").agg(F.min_by("key", F.struct(F.col("key") == "", "n_", -F.length("key"), "key")).alias("key"))
    return rules.join(ranked, "rule_no")


def matched_rules(requests: DataFrame, rules: DataFrame, id_column: str = "seq") -> DataFrame:
    """(id, rule_no): every rule of ``rules`` (rule_no, pattern) whose glob matches the URL of a row of ``requests`` (id, url).

    Rules find URLs by an equi join on keys, then the pattern decides; work grows with the candidates, not with rules times
    URLs.  A URL offers the text it starts with in the lengths that rules ask for, and its runs of a few characters.  Distinct URLs are looked up once
    each, keys that very many URLs share are spread.  NULL URLs and patterns match nothing.
    """
    keyed = checkpointed(_rule_keys(rule_patterns(rules.where("pattern IS NOT NULL").select("rule_no", "pattern"))))
    # lengths of pieces, no longer a list than URLs are long
    asked = keyed.agg(F.collect_set(F.when(F.col("key").startswith("^"), F.length("key") - 1)).alias("starts"), F.collect_set(F.when(F.col("key").startswith("~"), F.length("key") - 1)).alias("grams"), F.max(F.col("key") == "").alias("all")).first()
    offers = ["CAST(array() AS array<string>)"]
    if asked["starts"]:
        offers.append(f"transform(filter(array({', '.join(map(str, sorted(asked['starts'])))}), n -> n <= length(url)), n -> concat('^', substr(url, 1, n)))")
    for n in sorted(asked["grams"] or []):
        offers.append(f"IF(length(url) < {n}, CAST(array() AS array<string>), transform(sequence(1, greatest(length(url) - {n - 1}, 1)), k -> concat('~', substr(url, k, {n}))))")
    if asked["all"]:
        offers.append("array('')")
    urls = requests.select("url").where("url IS NOT NULL").distinct()
    offered = urls.select("url", F.explode(F.expr(in_memory(f"array_distinct(concat({', '.join(offers)}))"))).alias("key"))
    offered = checkpointed(offered.join(keyed.select("key").distinct(), "key", "left_semi"))
    pairs = salted_join(offered, keyed, "key", "url", how="inner").where("url RLIKE regex").select("url", "rule_no").distinct()
    return requests.select(id_column, "url").join(pairs, "url").select(id_column, "rule_no")


def _classes(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_no, first) of every rule and (rule_no, pattern) of the lowest rule of each class.

    Rules whose patterns are the same match the same URLs, so one of a class is looked up for all of them.
    """
    listed = rules.where("pattern IS NOT NULL AND rule_no IS NOT NULL").groupBy("rule_no").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
    listed = checkpointed(listed)
    firsts = checkpointed(listed.groupBy("patterns").agg(F.min("rule_no").alias("first")))
    return listed.join(firsts, "patterns").select("rule_no", "first"), firsts.select(F.col("first").alias("rule_no"), F.explode("patterns").alias("pattern"))


def rule_counts(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_no, n): how many rows of ``requests`` (url) every rule that matches any of them matches.

    The counts of ``matched_rules`` without its pairs, which grow with requests times rules where many rules are alike: distinct URLs meet one rule of a
    class, and the sums are handed to all of it.
    """
    members, firsts = _classes(rules)
    urls = checkpointed(requests.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n")).withColumn("id", F.col("url")))
    found = matched_rules(urls, firsts, "id").join(urls.select("id", "n"), "id")
    return found.groupBy(F.col("rule_no").alias("first")).agg(F.sum("n").alias("n")).join(members, "first").select("rule_no", "n")


def first_rule(requests: DataFrame, rules: DataFrame, id_column: str = "seq") -> DataFrame:
    """``requests`` with ``rule_no``, the lowest of the rules that match, NULL where none does."""
    urls = requests.select("url").where("url IS NOT NULL").distinct().withColumn("id", F.col("url"))
    of_url = matched_rules(urls, _classes(rules)[1], "id").groupBy(F.col("id").alias("url")).agg(F.min("rule_no").alias("rule_no"))
    first = requests.select(id_column, "url").join(of_url, "url").groupBy(id_column).agg(F.min("rule_no").alias("rule_no"))
    return requests.join(first, id_column, "left")
