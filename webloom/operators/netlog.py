"""Request, response, message and action logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.sqltext import lit
from webloom.functions.urls import glob_match, glob_regex
from webloom.operators.ordinals import numbered
from webloom.operators.skew import next_value, previous_value, running_max, salted_join

MERGE_LAST = "map_from_entries(transform(array_distinct(concat(map_keys({a}), map_keys({b}))), k -> struct(k AS key, coalesce({b}[k], {a}[k]) AS value)))"


def merge_headers(headers: str, overrides: str) -> str:
    """Header map with the overrides set on top, as SQL text."""
    return MERGE_LAST.format(a=headers, b=overrides)


def header_map(values: dict[str, str]) -> str:
    if not values:
        return "CAST(map() AS map<string,string>)"
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in values.items()) + ")"


def block_requests(requests: DataFrame, pattern: str, block: bool = True, overrides: dict[str, str] | None = None) -> DataFrame:
    """Requests without those whose URL matches a glob; with ``block`` off they stay and get the header overrides."""
    hit = F.expr(glob_match("url", pattern))
    if block:
        return requests.where(~hit)
    merged = F.expr(merge_headers("headers", header_map(overrides or {})))
    return requests.withColumn("headers", F.when(hit, merged).otherwise(F.col("headers")))


def har_join(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the response columns status, status_text, response_headers.

    A response belongs to the first request of its URL and the last response of a URL counts; other requests of the URL get
    none.  First and last are aggregates, so a URL with very many requests is reduced before it moves.
    """
    first = requests.groupBy("url").agg(F.min("seq").alias("seq"))
    last = responses.groupBy("url").agg(
        F.max_by(F.struct("status", "status_text", F.col("headers").alias("response_headers")), F.struct("ts", "seq")).alias("r")
    )
    answers = first.join(last, "url").select("seq", "r.*")
    return requests.join(answers, "seq", "left")


def mock_override(requests: DataFrame, rules: list[dict]) -> DataFrame:
    """Requests with mock_status, mock_body and mock_type set by the first rule whose glob matches, else NULL."""
    out = requests
    hits = [
        f"IF(url RLIKE {lit(glob_regex(r['pattern']))}, struct(CAST({int(r.get('status', 200))} AS INT) AS status, {lit(r.get('body', ''))} AS body), NULL)"
        for r in rules
    ]
    out = out.withColumn("m_", F.expr(f"coalesce({', '.join(hits)})" if len(hits) > 1 else hits[0]))
    return out.withColumns(
        {
            "mock_status": F.col("m_.status"),
            "mock_body": F.col("m_.body"),
            "mock_type": F.when(F.col("m_").isNotNull(), F.lit("application/json")),
        }
    ).drop("m_")


def ws_summary(messages: DataFrame) -> DataFrame:
    """(url, sent, received, messages, closed) per socket from (ts, url, type, payload)."""
    return messages.groupBy("url").agg(
        F.count_if(F.col("type") == "sent").alias("sent"),
        F.count_if(F.col("type") == "received").alias("received"),
        F.count_if(F.col("type").isin("sent", "received")).alias("messages"),
        F.coalesce(F.bool_or(F.col("type") == "closed"), F.lit(False)).alias("closed"),
    )


def ws_payloads(messages: DataFrame, length: int | None = None) -> DataFrame:
    """Messages with the payload cut to its first characters, as a report shows them; whole without a length."""
    return messages if length is None else messages.withColumn("payload", F.substring("payload", 1, length))


def attempt_outcome(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """(job_id, attempts, ok, output, last_error): first success within the allowed attempts, else the last error."""
    tried = attempts.where(F.col("attempt") <= max_attempts)
    out = tried.groupBy("job_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"),
        F.min_by(F.when(F.col("ok"), F.col("output")), F.when(F.col("ok"), F.col("attempt"))).alias("output"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("attempt"))).alias("error"),
    )
    done = F.col("first_ok").isNotNull()
    return out.select(
        "job_id",
        F.coalesce("first_ok", F.lit(max_attempts)).cast("bigint").alias("attempts"),
        done.alias("ok"),
        F.when(done, F.col("output")).alias("output"),
        F.when(~done, F.col("error")).alias("last_error"),
    )


def merged_actions(server: DataFrame, browser: DataFrame) -> DataFrame:
    """Both action logs in one order: by timestamp (missing counts as 0), server first on a tie."""
    a = server.withColumn("source", F.lit(0))
    b = browser.withColumn("source", F.lit(1))
    merged = a.unionByName(b, allowMissingColumns=True)
    return merged.orderBy(F.coalesce("ts", F.lit(0)), "source", "seq")


def numbered_actions(server: DataFrame, browser: DataFrame) -> DataFrame:
    """The merged actions with ``action_no``, their place from 0; counted per range of the order, no task sees all of them."""
    merged = server.withColumn("source", F.lit(0)).unionByName(browser.withColumn("source", F.lit(1)), allowMissingColumns=True)
    ordered = merged.withColumn("at_", F.coalesce("ts", F.lit(0)))
    return numbered(ordered, ["at_", "source", "seq"], "action_no").drop("at_")


def replay_delays(actions: DataFrame, speed: float = 1.0) -> DataFrame:
    """Actions (session_id, bucket, ts in ms, seq, …) with the pause before each in seconds; 0 when time does not advance."""
    out = previous_value(actions, ["session_id"], "bucket", ["ts", "seq"], "ts", "previous_ts")
    before = F.coalesce("previous_ts", F.lit(0.0))
    delay = F.when(F.col("ts") > before, (F.col("ts") - before) / 1000 / speed).otherwise(F.lit(0.0))
    return out.withColumn("delay", delay).drop("previous_ts")


def session_history(visits: DataFrame) -> DataFrame:
    """Visits (session_id, bucket, seq, url) with back_url and forward_url, NULL at the ends."""
    out = previous_value(visits, ["session_id"], "bucket", ["seq"], "url", "back_url")
    return next_value(out, ["session_id"], "bucket", ["seq"], "url", "forward_url")


def network_idle(requests: DataFrame, gap_us: int) -> DataFrame:
    """(page_url, start_us, idle_at_us, n): bursts of requests; the network is idle once nothing came for the gap.

    ``requests`` is (page_url, bucket, us, seq) with times in microseconds.
    """
    steps = previous_value(requests, ["page_url"], "bucket", ["us", "seq"], "us", "before")
    opens = F.col("before").isNull() | (F.col("us") - F.col("before") >= gap_us)
    steps = steps.withColumn("opened", F.when(opens, F.col("us")))
    bursts = running_max(steps, ["page_url"], "bucket", ["us", "seq"], "opened", "start_us")
    return bursts.groupBy("page_url", "start_us").agg((F.max("us") + gap_us).alias("idle_at_us"), F.count("*").alias("n"))


def record_actions(events: DataFrame) -> DataFrame:
    """Recorded actions (session_id, type, ts_us, rel_us, …): clicks, inputs and the keys that a recording keeps.

    Keys are single characters, Enter, Tab and Backspace; times count from the first recorded event of the session.
    """
    kept = events.where("type <> 'keypress' OR length(key) = 1 OR key IN ('Enter', 'Tab', 'Backspace')")
    start = kept.groupBy("session_id").agg(F.min("ts_us").alias("start_us"))
    return salted_join(kept, start, "session_id", "ts_us").withColumn("rel_us", F.col("ts_us") - F.col("start_us")).drop("start_us")
