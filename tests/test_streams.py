"""Stream state that is freed, and streams that move keys instead of pages."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from webloom.operators import audit, dom, extract
from webloom.operators.state import kv_fold
from webloom.sources import readers
from webloom.streaming import jobs
from webloom.streaming.kv_store import kv_live, live_keys, with_map_state

OPS = "store STRING, seq BIGINT, op STRING, key STRING, value STRING"


def stream_of(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cleared_keys_leave_the_state(spark, tmp_path):
    batches = [
        [("a", 1, "set", "x", "1"), ("a", 2, "set", "y", "2"), ("b", 3, "set", "x", "3"), ("b", 4, "set", None, "lost")],
        [("a", 6, "clear", None, None), ("a", 7, "set", "z", "7"), ("a", 5, "set", "late", "5")],  # seq 5 is older than the clear
        [("a", 9, "set", "x", "9"), ("a", 8, "set", "x", "8"), ("b", 2, "set", "x", "older"), ("c", 1, "clear", None, None)],
    ]
    folder = str(tmp_path / "out")
    stream = stream_of(spark, str(tmp_path / "in"), batches, OPS)
    with with_map_state(spark):
        changes = jobs.replay(spark, kv_live(stream, parts=3), "update", ["store", "key"], folder=folder)
        kept = {tuple(r) for r in live_keys(spark, folder).collect()}
    assert kept == {("a", "x"), ("a", "z"), ("b", "x")}
    live = {tuple(r) for r in changes.where("NOT gone").select("store", "key", "value").collect()}
    assert live == {("a", "x", "9"), ("a", "z", "7"), ("b", "x", "3")}
    ops = spark.createDataFrame([r for b in batches for r in b], OPS).where("key IS NOT NULL OR op = 'clear'")
    assert live == {tuple(r) for r in kv_fold(ops).collect()}


def test_new_pages_are_chosen_by_keys(spark, tmp_path):
    pages = [[(1, "http://h/1", "<a href=/x>x</a>")], [(7, "http://h/1", "<a href=/again>x</a>"), (2, "http://h/2", "<a href=/y>x</a><a href=/z>z</a>")], [(3, None, "<a href=q>")]]
    stream = stream_of(spark, str(tmp_path / "in"), pages, readers.PAGE_SCHEMA)
    for few in (100, 0):
        got = jobs.extract_new(spark, stream, extract.link_targets, few=few).collect()
        assert {(r["page_id"], r["href"]) for r in got if r["page_id"] < 3} == {(1, "http://h/x"), (2, "http://h/y"), (2, "http://h/z")}
    keys = spark.createDataFrame([(1, "http://h/1")], "page_id BIGINT, url STRING")
    stored = spark.read.schema(readers.PAGE_SCHEMA).parquet(str(tmp_path / "in"))
    for few in (100, 0):
        out = io.StringIO()
        with redirect_stdout(out):
            jobs.of_keys(stored, keys, extract.link_targets, few).explain("formatted")
        moved = [line for block in out.getvalue().split(") Exchange\n")[1:] for line in block.split("\n")[:1]]
        assert not any("html" in line for line in moved)


def test_limit_of_rows(spark):
    rows = spark.createDataFrame([(p, k, f"r{k}") for p in range(3) for k in range(p * 3)], "page_id BIGINT, pos INT, v STRING")
    assert dom.limit(rows, 0).count() == 9 and dom.limit(rows, 4).count() == 7
    assert sorted(tuple(r) for r in dom.limit(rows, 1).collect()) == [(1, 0, "r0"), (2, 0, "r0")]


def test_line_numbers_of_files_in_splits(spark, tmp_path):
    folder = tmp_path / "urls"
    folder.mkdir()
    want = []
    for name, n in (("b.txt", 700), ("a.txt", 300), ("c.txt", 0)):
        (folder / name).write_text("".join("\n" if k % 5 == 2 else f" http://{name}/{k} \n" for k in range(n)))
    for name, n, before in (("a.txt", 300, 0), ("b.txt", 700, 300)):
        want += [(before + k, f"http://{name}/{k}") for k in range(n) if k % 5 != 2]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = readers.url_list(spark, str(folder))
        assert sorted(tuple(r) for r in got.select("line_no", "url").collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sketches_merge_to_the_quantile(spark):
    rows = spark.range(20000).select(F.expr("IF(id % 3 = 0, 'hot', concat('h', id % 7))").alias("host"), (F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 20011).cast("double").alias("ttfb"), F.lit(None).cast("double").alias("fcp"))
    hourly = audit.vitals_sketches(rows, ["host", "hour"], metrics=["ttfb", "fcp"])
    found = {r["host"]: r for r in audit.vitals_quantile(audit.merged_sketches(hourly, ["host"])).collect()}
    exact = {r["host"]: r for r in rows.groupBy("host").agg(F.collect_list("ttfb").alias("v")).collect()}
    assert found.keys() == exact.keys() and {r["metric"] for r in found.values()} == {"ttfb"}
    for host, r in found.items():
        values = exact[host]["v"]
        assert r["n"] == len(values) and abs(sum(v <= r["value"] for v in values) / len(values) - 0.75) < 0.01
