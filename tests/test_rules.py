"""Rule tables against the standard library's shell patterns, positions in a global order, archives of many entries."""

import fnmatch
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from webloom.functions.sqltext import lit
from webloom.functions.urls import url_join
from webloom.operators.ordinals import numbered
from webloom.operators.rules import first_rule, matched_rules
from webloom.sources import readers


def test_rules_match_as_shell_patterns_do(spark):
    rng = random.Random(6)
    alphabet = "abc/.:%+-_^$\\(é"
    urls = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["https://h.example/a/b", "https://h.example/", "line\nbreak", None]
    parts = ["*", "?", "[ab]", "[!a/]", "[a-c]", "[]a]", "[^b]", "[", "a", "b/", "abc", ".", "\\", "(", "$", "é", "%+"]
    patterns = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(400)] + ["*", "**", "", "https://*", "https://h.example/?/b", "*example*", "line*", None]
    rules = spark.createDataFrame(list(enumerate(patterns)), "rule_no BIGINT, pattern STRING")
    requests = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(9000, urls[0])], "seq BIGINT, url STRING")
    got = {tuple(r) for r in matched_rules(requests, rules).collect()}
    want = {(k, n) for k, u in [*enumerate(urls), (9000, urls[0])] for n, p in enumerate(patterns) if u is not None and p is not None and fnmatch.fnmatchcase(u, p)}
    assert got == want
    first = {r["seq"]: r["rule_no"] for r in first_rule(requests, rules).collect()}
    assert first == {k: min((n for i, n in want if i == k), default=None) for k in [*range(len(urls)), 9000]}


def test_ten_thousand_rules_without_a_nested_loop(spark, capsys):
    rules = spark.range(10_000).selectExpr("id AS rule_no", "IF(id % 2 = 0, concat('https://h.example/', id, '/*'), concat('*/item/', id)) AS pattern")
    requests = spark.range(20_000).selectExpr("id AS seq", "concat('https://h.example/', id % 30000, '/item/', id + 1) AS url")
    found = matched_rules(requests, rules)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the even rule of the first number and the odd one of the last, where there are such
    assert found.count() == 5000 + sum(1 for k in range(20_000) if (k + 1) % 2 and k + 1 < 10_000)


def test_no_rules_and_no_urls(spark):
    none, urls = spark.createDataFrame([], "rule_no BIGINT, pattern STRING"), spark.createDataFrame([(1, "a")], "seq BIGINT, url STRING")
    assert matched_rules(urls, none).collect() == []
    assert [tuple(r) for r in first_rule(urls, none).select("seq", "rule_no").collect()] == [(1, None)]
    assert matched_rules(urls.limit(0), none.unionByName(spark.createDataFrame([(1, "*")], none.schema))).collect() == []


def test_positions_in_a_global_order(spark):
    rows = spark.range(5000, numPartitions=7).selectExpr("id", "IF(id % 3 = 0, 42, id * 7919 % 1009) AS v")
    got = sorted((r["at"], r["v"]) for r in numbered(rows, ["v"], "at").collect())
    assert [at for at, _ in got] == list(range(5000))
    assert [v for _, v in got] == sorted(r["v"] for r in rows.collect())
    assert numbered(rows.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("base,ref", [("http://h/d/e", "HTTP://X/y?q#f"), ("https://h/", "HTTP://X/y"), ("HTTP://h/d", "e"), ("HTTP://h/d", "//Other/x"), ("http://h/d", "Mailto:a@b"), ("http://h/d/", "HtTp://X")])
def test_schemes_of_joined_urls(spark, base, ref):
    assert spark.sql(f"SELECT {url_join(lit(base), lit(ref))} AS u").first()["u"] == urljoin(base, ref)


def test_a_million_entries_of_one_key(spark):
    n = 1_000_000
    sent = spark.range(n, numPartitions=8).selectExpr("id AS seq", "'hot' AS session", "concat('http://h/', id) AS url", "'GET' AS method", "map('a', CAST(id AS STRING)) AS headers")
    documents = readers.har_documents(sent, "session")
    got = readers.har_entries(documents)
    row = got.select(F.count("*"), F.count_if(F.expr("url = concat('http://h/', part * 100000 + entry_no) AND headers['a'] = CAST(part * 100000 + entry_no AS STRING)")), F.countDistinct("part")).first()
    assert tuple(row) == (n, n, 10)
