"""Stream forms of the log and page operators.

Each function takes a streaming DataFrame and returns one.  ``replay`` runs a stream over everything that has arrived
and gives the result as a table; a live job uses ``start`` with the same arguments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.session import shared_folder


def monitor(messages: DataFrame, duration: str, late: str = "10 minutes") -> DataFrame:
    """(start, url, type, n): messages per socket and kind in fixed windows, from (ts, url, type, payload)."""
    windows = messages.withWatermark("ts", late).groupBy(F.window("ts", duration), "url", "type").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "url", "type", "n")


def network_idle(requests: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(page_url, start, idle_at, n): bursts of requests that a pause of ``gap`` has ended, from (ts, page_url)."""
    bursts = requests.withWatermark("ts", late).groupBy("page_url", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return bursts.select("page_url", F.col("w.start").alias("start"), F.col("w.end").alias("idle_at"), "n")


def kv_changes(ops: DataFrame) -> DataFrame:
    """(store, key, value, seq): latest operation per key; a clear is the row with key NULL.

    The state holds one row per live key and store.  ``kv_state`` turns the emitted rows into the current content.
    """
    key = F.when(F.col("op") == "set", F.col("key"))
    return ops.groupBy("store", key.alias("key")).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def kv_state(changes: DataFrame) -> DataFrame:
    """(store, key, value): current content from the rows that ``kv_changes`` has emitted so far."""
    last = changes.groupBy("store", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    clears = last.where("key IS NULL").select("store", F.col("seq").alias("cleared"))
    live = last.where("key IS NOT NULL").join(clears, "store", "left").where("cleared IS NULL OR seq > cleared")
    return live.select("store", "key", "value")


def record_actions(events: DataFrame) -> DataFrame:
    """Recorded actions as they come: clicks, inputs and the keys that a recording keeps; append only, no state."""
    return events.where("type <> 'keypress' OR length(key) = 1 OR key IN ('Enter', 'Tab', 'Backspace')")


def first_seen(pages: DataFrame, late: str | None = None, ts: str = "ts") -> DataFrame:
    """Pages whose URL has not come before; with ``late`` the memory is limited to that span of event time."""
    if late is None:
        return pages.dropDuplicates(["url"])
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def first_seen_keys(pages: DataFrame, late: str = "30 days") -> DataFrame:
    """(url, page_id, path): pages of a file stream whose URL has not come before, without what they hold.

    ``path`` is the file that holds the page.  URLs are remembered for ``late`` after their file was written, so the state is bounded; a URL
    that comes again later is new.
    """
    keys = pages.select("url", "page_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"))
    return keys.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["url"]).drop("arrived")


def of_keys(pages: DataFrame, keys: DataFrame, extract: Callable[[DataFrame], DataFrame], few: int = 100_000) -> DataFrame:
    """Rows of ``extract`` for the pages that ``keys`` (page_id, url) names; no page crosses the network.

    Up to ``few`` keys go to every task, which then parses their pages only.  More of them meet the extracted rows instead, which carry page_id:
    all pages are parsed where they lie, and only results move.
    """
    if keys.count() <= few:
        return extract(pages.join(F.broadcast(keys), ["page_id", "url"], "left_semi"))
    return extract(pages).join(keys.select("page_id"), "page_id", "left_semi")


def extract_new(
    spark: SparkSession, pages: DataFrame, extract: Callable[[DataFrame], DataFrame], folder: str | None = None, late: str = "30 days", few: int = 100_000
) -> DataFrame:
    """Rows of ``extract`` for the first page of every URL in a file stream that has arrived, as a table.

    Which pages are new is decided on keys; their HTML is read from their files once that is known.
    """
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def rows(keys: DataFrame) -> DataFrame:
        found = keys.persist()
        # files of one micro-batch
        paths = [r["path"] for r in found.select("path").distinct().collect()]
        stored = spark.read.schema(pages.schema)
        source = stored.parquet(*paths) if paths else spark.createDataFrame([], pages.schema)
        return of_keys(source, found.select("page_id", "url"), extract, few)

    start(first_seen_keys(pages, late), folder, "append", rows, once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def start(
    stream: DataFrame, folder: str, mode: str = "append", extract: Callable[[DataFrame], DataFrame] | None = None, once: bool = False
) -> StreamingQuery:
    """Write a stream below ``folder``, one sub-folder per micro-batch.

    A repeated micro-batch overwrites its own sub-folder, so every row arrives exactly once.  ``extract`` is any batch operator,
    applied to each micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = extract(batch) if extract else batch
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay_closed(spark: SparkSession, source: DataFrame, job: Callable[[DataFrame], DataFrame], keep: str, ts: str = "ts", folder: str | None = None) -> DataFrame:
    """Run an append job over all that has arrived and have it give its last windows and sessions too.

    In append mode a window comes out once the watermark has passed it, which the last ones wait for.  A closing row far
    in the future, in a folder that the job reads beside its source, moves the watermark there.  All its other columns are NULL;
    ``keep`` is the condition that its own results do not meet.  It is applied to the results, as the optimiser would
    move a filter of the job itself below the watermark.
    """
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    closing = f"{folder}/closing"
    rows = spark.createDataFrame([("2900-01-01 00:00:00",)], "t_ STRING").select(
        *[F.to_timestamp("t_").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    )
    rows.limit(0).write.parquet(closing)
    whole = source.unionByName(spark.readStream.schema(source.schema).parquet(closing))
    start(job(whole), folder, "append", once=True).awaitTermination()
    for _ in range(2):  # the first row moves the watermark, the batch of the second one sees it
        rows.write.mode("append").parquet(closing)
        start(job(whole), folder, "append", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").where(keep).drop("batch")


def replay(
    spark: SparkSession,
    stream: DataFrame,
    mode: str = "append",
    keys: list[str] | None = None,
    extract: Callable[[DataFrame], DataFrame] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Run a stream over all that has arrived and return its result.

    append: all rows; update: the last version per ``keys``; complete: the rows of the last micro-batch.
    """
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = start(stream, folder, mode, extract, once=True)
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "update":
        row = F.struct(*[c for c in rows.columns if c not in (*(keys or []), "batch")])
        return rows.groupBy(*(keys or [])).agg(F.max_by(row, "batch").alias("r_")).select(*(keys or []), "r_.*")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch").alias("b")).scalar()).drop("batch")
    return rows.drop("batch")
