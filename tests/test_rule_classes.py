"""Rules that are alike are matched once for all of them."""

import time

from pyspark.sql import functions as F

from webloom.operators.rules import first_rule, matched_rules, rule_counts


def test_counts_and_first_rules_equal_the_pairs(spark):
    patterns = ["*", "https://h/*", "https://h/1?", "*/[0-4]", "none*", None]
    rows = [(n, patterns[n % 6]) for n in range(40)] + [(3, "https://h/*"), (4, "*"), (7, "*"), (7, "*"), (None, "*")]
    rules = spark.createDataFrame(rows, "rule_no BIGINT, pattern STRING")
    requests = spark.createDataFrame([(k % 50, f"https://h/{k % 17}") for k in range(60)] + [(90, None), (None, "https://h/1")], "seq BIGINT, url STRING")
    want = {r["rule_no"]: r["n"] for r in matched_rules(requests, rules).groupBy("rule_no").agg(F.count("*").alias("n")).collect()}
    assert {r["rule_no"]: r["n"] for r in rule_counts(requests, rules).collect()} == want
    pairs = matched_rules(requests, rules).groupBy("seq").agg(F.min("rule_no").alias("rule_no"))
    by_id = lambda df: sorted(map(repr, df.select("seq", "url", "rule_no").collect()))
    assert by_id(first_rule(requests, rules)) == by_id(requests.join(pairs, "seq", "left"))


def test_equal_rules_are_not_multiplied_with_requests(spark):
    rules = spark.range(60_000).selectExpr("id AS rule_no", "concat('*/error/', id % 3) AS pattern")
    requests = spark.range(60_000).selectExpr("id AS seq", "concat('https://h/error/', id % 4) AS url")
    start = time.time()  # 900 million pairs
    assert rule_counts(requests, rules).groupBy("n").count().collect() == [(15_000, 60_000)]
    assert first_rule(requests, rules).groupBy("rule_no").count().orderBy("rule_no").collect() == [(None, 15_000), (0, 15_000), (1, 15_000), (2, 15_000)]
    assert time.time() - start < 60
