"""The stream forms, replayed over the tables; the SQL is that of the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.extract import link_targets
from webloom.plans import fixtures as fx
from webloom.plans.fixtures import EPOCH
from webloom.plans.log_queries import EV, GAP
from webloom.plans.page_queries import DECODE, HREF, LINKS, ORIGIN, pages
from webloom.plans.registry import ORACLES, query
from webloom.session import shared_folder
from webloom.sources.readers import PAGE_SCHEMA, table_stream
from webloom.streaming import jobs
from webloom.streaming.kv_store import kv_live, live_keys, with_map_state

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; ``ts`` becomes an instant, as watermarks need one."""
    raw = table_stream(spark, sf_dir, "events.parquet", EVENT_SCHEMA)
    return raw.withColumn("ts", F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, ts))"))


@query("stream_monitor", """
SELECT epoch_us(date_trunc('hour', ts)) AS start_us, 'wss://live.example.com/' || user_id AS url, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = events(spark, sf_dir).selectExpr("ts", "concat('wss://live.example.com/', user_id) AS url", "event_type AS type")
    out = jobs.replay(spark, jobs.monitor(messages, "1 hour"), "update", ["start", "url", "type"])
    return out.select(F.expr("unix_micros(start)").alias("start_us"), "url", "type", "n")


@query("stream_network_idle", ORACLES["network_idle"])
def stream_network_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).selectExpr("ts", "concat('https://app.example.com/u/', user_id) AS page_url")
    out = jobs.replay_closed(spark, requests, lambda stream: jobs.network_idle(stream, f"{GAP} microseconds", "1 hour"), "page_url IS NOT NULL")
    return out.select("page_url", F.expr("unix_micros(start)").alias("start_us"), F.expr("unix_micros(idle_at)").alias("idle_at_us"), "n")


@query("stream_kv_fold", ORACLES["kv_fold"])
def stream_kv_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = events(spark, sf_dir).selectExpr(
        "event_id AS seq", "concat('s', user_id) AS store", "IF(event_type = 'signup', 'clear', 'set') AS op",
        "concat('k', CAST(get_json_object(props, '$.k') AS BIGINT) % 10) AS key", "CAST(value AS STRING) AS value",
    )
    return jobs.kv_state(jobs.replay(spark, jobs.kv_changes(ops), "update", ["store", "key"]))


@query("stream_record_actions", f"""
WITH {EV} SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'input' ELSE 'keypress' END AS type FROM ev
WHERE event_type IN ('click', 'view') OR k % 4 <> 1""")
def stream_record_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = events(spark, sf_dir).selectExpr(
        "event_id AS seq", "CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'input' ELSE 'keypress' END AS type",
        "CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE get(array('Enter', 'Shift', 'a', 'a'), CAST(CAST(get_json_object(props, '$.k') AS BIGINT) % 4 AS INT)) END AS key",
    )
    return jobs.replay(spark, jobs.record_actions(actions)).select("seq", "type")


@query("stream_extract_links", f"""
WITH {LINKS} SELECT page_id, {ORIGIN} || {DECODE.format(HREF)} AS href FROM links""")
def stream_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.extract_new(spark, table_stream(spark, sf_dir, "pages.parquet", PAGE_SCHEMA), link_targets).select("page_id", "href")


@query("stream_new_pages", """
SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), '') AS h1 FROM pages""")
def stream_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come again in later files, with other ids and contents, are not taken again."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    stored = pages(spark, sf_dir)
    again = stored.select((F.col("page_id") + 1_000_000).alias("page_id"), "url", F.concat(F.lit("<h1>again</h1>"), "html").alias("html"))
    for part in (stored.where("page_id % 2 = 0"), again.where("page_id % 2 = 0"), stored.where("page_id % 2 = 1"), again):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    first_heading = lambda p: p.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))
    return jobs.extract_new(spark, stream, first_heading)


FILE_ROWS = 250_000  # operations of a file at most, about


def _kv_stream(spark: SparkSession, sf_dir: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """The operations in four micro-batches, so that clears meet keys that are state already; one file each where they are few."""
    folder = f"{shared_folder(spark)}/ops-{uuid.uuid4().hex}"
    ops = fx.kv_ops(spark, sf_dir).select("store", "seq", "op", "key", "value")
    files = max(1, -(-ops.count() // (4 * file_rows)))
    for part in range(4):
        ops.where(F.col("seq") % 4 == part).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("stream_kv_live", ORACLES["kv_fold"])
def stream_kv_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    with with_map_state(spark):
        out = jobs.replay(spark, kv_live(_kv_stream(spark, sf_dir)), "update", ["store", "key"])
    return out.where("NOT gone").select("store", "key", "value")


@query("stream_kv_state_size", f"SELECT store, count(*) AS n FROM ({ORACLES['kv_fold']}) GROUP BY store")
def stream_kv_state_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in the state of the stream, which are the live ones: those of cleared stores have been freed."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with with_map_state(spark):
        jobs.start(kv_live(_kv_stream(spark, sf_dir)), folder, "update", once=True).awaitTermination()
        return live_keys(spark, folder).groupBy("store").agg(F.count("*").alias("n"))
