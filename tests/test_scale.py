"""Plans and skew: what has to hold when the data is a thousand times larger."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from webloom.operators import audit, content, crawl, dom, extract, netlog, recon
from webloom.operators.skew import hot_keys, next_value, previous_value, running_max, salted_join
from webloom.sources import readers
from webloom.streaming import jobs


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def stored(spark, sf_dir):
    return readers.pages(spark, sf_dir)


@pytest.mark.parametrize(
    "operator",
    [
        lambda p: extract.extract_text(p, "article p"),
        lambda p: extract.extract_links(p, absolute=True),
        lambda p: dom.element_table(p),
        lambda p: audit.a11y_summary(p),
        lambda p: audit.heading_order(p),
        lambda p: dom.nth_child(dom.dom(p), "li", 2),
        lambda p: dom.select(dom.dom(p), "li:nth-child(odd)"),
        lambda p: audit.seo_audit(p),
        lambda p: recon.recon(p),
        lambda p: content.smart_document(p),
        lambda p: content.has_selector(p, "h1"),
    ],
)
def test_page_operators_do_not_shuffle(stored, operator):
    text = plan(operator(stored))
    assert "Exchange" not in text and "Python" not in text


def test_parsed_columns_are_computed_once(stored):
    # the tokeniser pattern stands once in the plan of a filter on parsed columns
    text = plan(content.has_selector(stored, "h1"))
    assert text.count("Arguments: explode") + text.count("+- * Generate") >= 1
    assert "Filter" in text and text.split("(1) Scan parquet")[1].count("Condition : ((size(") == 0


def test_url_filter_reaches_the_scan(stored):
    from webloom.functions.urls import glob_match

    text = plan(stored.where(F.expr(glob_match("url", "https:*"))).select("url"))
    assert "StringStartsWith(url,https:)" in text and "ReadSchema: struct<url:string>" in text


def test_salted_join_with_a_hot_key(spark):
    left = spark.range(20000).select("id", F.expr("IF(id % 3 = 0, 'hot', concat('k', id % 997))").alias("k"))
    right = spark.range(900).select(F.expr("concat('k', id)").alias("k"), F.col("id").alias("v")).union(spark.sql("SELECT 'hot', -1L"))
    assert [tuple(r) for r in hot_keys(left, "k", rows=500).collect()] == [("hot", 14)]
    # a key of a thousandth of the rows is spread as well where tasks are to be that small
    assert hot_keys(left, "k", rows=10).where("k = 'k1' AND salts_ = 2").count() == 1
    got = salted_join(left, right, "k", "id", rows=500).groupBy().agg(F.count("*"), F.count("v"), F.sum("v")).first()
    want = left.join(right, "k", "left").groupBy().agg(F.count("*"), F.count("v"), F.sum("v")).first()
    assert got == want


def moved(df):
    """What every exchange of the plan carries."""
    import re

    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan(df))


def test_no_html_crosses_the_network(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        urls = stored.select(F.col("page_id").alias("line_no"), "url")
        narrow = crawl.one_per_url(stored, extract.link_targets(stored))
        found = [crawl.batch_urls(urls, stored, "h1"), crawl.link_edges(stored, domain="example.com"), narrow, audit.broken_links(stored, stored.select("url", F.lit(200).alias("status")))]
        carried = [c for df in found for c in moved(df)]
        assert carried and not any("html#" in c or "els#" in c or "toks#" in c for c in carried)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_two_level_windows_equal_plain_ones(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select(
        F.expr("IF(id % 3 = 0, 'hot', concat('k', id % 7))").alias("k"), F.expr("CAST(hash(id) % 100000 AS BIGINT)").alias("t"), "id", F.expr("IF(hash(id, 1) % 2 = 0, id, NULL)").alias("v")
    ).withColumn("b", F.expr("t DIV 5000"))
    df = df.withColumn("b", F.expr("CAST(floor(t / 5000) AS BIGINT)"))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w)).withColumn("m", F.max("v").over(w))
    got = previous_value(df, ["k"], "b", ["t", "id"], "v", "p")
    got = next_value(got, ["k"], "b", ["t", "id"], "v", "n")
    got = running_max(got, ["k"], "b", ["t", "id"], "v", "m")
    cols = ["k", "t", "id", "p", "n", "m"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and want.count() == got.count()


def test_first_and_last_response_are_aggregates(spark):
    req = spark.range(1000).select(F.col("id").alias("seq"), F.expr("IF(id % 3 = 0, 'hot', concat('u', id))").alias("url"))
    res = spark.range(1000).select(F.col("id").alias("ts"), F.col("id").alias("seq"), F.lit("hot").alias("url"), F.col("id").cast("int").alias("status"), F.lit("s").alias("status_text"), F.expr("map('a', 'b')").alias("headers"))
    out = netlog.har_join(req, res)
    assert "Window" not in plan(out)
    assert out.where("status IS NOT NULL").select("seq", "status").collect() == [(0, 999)]


def test_streams_over_several_files_equal_the_batch(spark, tmp_path):
    rows = spark.range(300).select(
        F.expr("timestamp_micros(id * 7000000)").alias("ts"), F.expr("concat('p', id % 4)").alias("page_url"), F.expr("concat('p', id % 4)").alias("url"), F.lit("sent").alias("type"),
        F.col("id").alias("seq"), F.expr("IF(id % 50 = 0, 'clear', 'set')").alias("op"), F.expr("concat('k', id % 5)").alias("key"), F.expr("concat('v', id)").alias("value"), F.expr("concat('s', id % 3)").alias("store"),
    )
    for part in range(3):
        rows.where(f"seq DIV 100 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.replay(spark, jobs.monitor(stream, "1 minute", "1 hour"), "update", ["start", "url", "type"])
    want = rows.groupBy(F.window("ts", "1 minute").start.alias("start"), "url", "type").agg(F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    from webloom.operators.state import kv_fold

    kv = jobs.kv_state(jobs.replay(spark, jobs.kv_changes(stream), "update", ["store", "key"]))
    want = kv_fold(rows)
    assert kv.exceptAll(want).count() == 0 and kv.count() == want.count()


def test_stream_takes_each_url_once(spark, page, tmp_path):
    one = page("<a href=/x>x</a>", url="http://h/1")
    for _ in range(2):
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    stream = readers.page_stream(spark, str(tmp_path / "pages"))
    out = jobs.replay(spark, jobs.first_seen(stream), extract=extract.link_targets)
    assert [r["href"] for r in out.collect()] == ["http://h/x"]
