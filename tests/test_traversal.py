"""Traversal at scale: what moves at a level of a crawl, and walks over long and merging lists."""

import io
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.session import bucketed, forget

PAGES = "page_id BIGINT, url STRING, html STRING"


def exchanges(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    assert "BroadcastExchange" not in out.getvalue()
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", out.getvalue())


def test_a_level_moves_the_targets_only(spark):
    html = "concat('<title>t', id, '</title>', array_join(transform(sequence(1, 4), k -> concat('<a href=/', 4 * id + k, '>x</a>')), ''))"
    pages = spark.range(2000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"{html} AS html")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, pages_name = crawl.site(pages, "h")
        visited, visits = bucketed(spark.createDataFrame([("http://h/0", 0)], "url string, depth int"), "url")
        level = crawl.next_level(stored, visited, 1)
        moved = exchanges(level)
        assert len(moved) == 1 and re.fullmatch(r"url#\d+", moved[0])
        assert sorted(r["url"] for r in level.collect()) == [f"http://h/{k}" for k in (1, 2, 3, 4)]
        # nor does anything else when the visited URLs meet their pages
        assert exchanges(visited.join(stored.drop("targets"), "url", "left")) == []
        forget(spark, pages_name, visits)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = crawl.crawl(pages, "http://h/0", depth=4)
    assert Counter(r["depth"] for r in found.collect()) == {0: 1, 1: 4, 2: 16, 3: 64, 4: 256}
    assert spark.catalog.listTables() == []


def test_crawl_with_copies_cycles_and_missing_pages(spark):
    rows = [(1, "http://h/a", "<a href=b></a><a href=b></a><a href=a></a>"), (2, "http://h/b", "<a href=a></a><a href=c></a>"), (0, "http://h/b", "<title>B</title><a href=lost></a>")]
    got = {(r["url"], r["depth"], r["title"], r["error"]) for r in crawl.crawl(spark.createDataFrame(rows, PAGES), "http://h/a", depth=5).collect()}
    assert got == {("http://h/a", 0, "", None), ("http://h/b", 1, "B", None), ("http://h/lost", 2, None, "page not stored")}


def plain_walks(next_of, starts, limit):
    out = {}
    for start in starts:
        walk, at = [], start
        while at in next_of and (limit is None or len(walk) < limit):
            if limit is None and at in walk:
                break
            walk.append(at)
            at = next_of[at]
        out[start] = walk
    return out


@pytest.mark.parametrize("limit", [None, 1, 7, 50])
def test_walks_that_merge_and_come_back(spark, limit):
    # a list of 60, branches into it, a round of 9 with a tail, a round that nothing leads to, and a link to itself
    next_of = {k: k + 1 for k in range(59)} | {59: None} | {k: k // 2 for k in range(100, 140)} | {k: 200 + (k - 199) % 9 for k in range(200, 209)}
    next_of |= {k: k + 1 for k in range(300, 310)} | {310: 203} | {k: 400 + (k - 399) % 5 for k in range(400, 405)} | {500: 500, 600: 9999}
    rows = [(k, f"http://h/{k}", f"<li>{k}</li>" + ("" if n is None else f"<a class=next href=/{n}>n</a>")) for k, n in next_of.items()]
    pages = spark.createDataFrame(rows, PAGES)
    starts = [0, 5, 58, 101, 139, 200, 204, 300, 500, 600, 12345]
    items, counts = crawl.paginate(pages, spark.createDataFrame([(f"http://h/{k}",) for k in starts], "url STRING"), "a.next", "li", limit)
    got = {}
    for r in items.orderBy("start_url", "page_no").collect():
        got.setdefault(int(r["start_url"][9:]), []).append(int(r["item"]))
    want = plain_walks(next_of, starts, limit)
    assert got == {k: w for k, w in want.items() if w}
    clicks = {int(r["start_url"][9:]): r["pages"] for r in counts.collect()}
    assert clicks == {k: sum(next_of[p] is not None for p in w) for k, w in want.items() if w}


def test_a_list_of_100_000_pages(spark):
    n = 100_000
    pages = spark.range(n, numPartitions=8).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"concat('<li>x', IF(id < {n - 1}, concat('<a class=next href=/', id + 1, '>'), '')) AS html")
    items, counts = crawl.paginate(pages, spark.createDataFrame([("http://h/0",)], "url STRING"), "a.next", "li")
    assert tuple(counts.first()) == ("http://h/0", n - 1, n)
    assert items.agg(F.min("page_no"), F.max("page_no"), F.countDistinct("page_no")).first()[:] == (1, n, n)
