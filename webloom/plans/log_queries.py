"""Queries over request, message, action and key/value logs written from the event table, and set operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import audit, netlog, rules, state
from webloom.plans import fixtures as fx
from webloom.plans.registry import query, table
from webloom.sources import readers

EV = """ev AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("request_log", """
SELECT event_id AS seq, 'https://api.example.com/' || event_type || '/' || user_id AS url, CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method, event_type AS accept FROM events""")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.request_log(fx.requests(spark, sf_dir)).select("seq", "url", "method", F.expr("headers['accept']").alias("accept"))


@query("block_requests", """
SELECT event_id AS seq FROM events WHERE NOT ('https://api.example.com/' || event_type || '/' || user_id LIKE '%/error/%')""")
def block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.block_requests(fx.requests(spark, sf_dir), "*/error/*").select("seq")


@query("request_headers", """
SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'all' ELSE event_type END AS accept, CASE WHEN event_type = 'view' THEN 'no' END AS dnt, CAST(user_id AS VARCHAR) AS user FROM events""")
def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = netlog.block_requests(fx.requests(spark, sf_dir), "*/view/*", block=False, overrides={"accept": "all", "dnt": "no"})
    return out.selectExpr("seq", "headers['accept'] AS accept", "headers['dnt'] AS dnt", "headers['x-user'] AS user")


@query("clear_headers", "SELECT event_id AS seq, 0 AS n FROM events")
def clear_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.requests(spark, sf_dir).selectExpr("seq", f"CAST(size({netlog.header_map({})}) AS BIGINT) AS n")


@query("har_join", """
WITH f AS (SELECT event_type, user_id, min(event_id) AS first, arg_max(event_id, ts) AS last FROM events GROUP BY 1, 2)
SELECT e.event_id AS seq, CASE WHEN f.first IS NOT NULL THEN CASE WHEN e.event_type = 'error' THEN 500 ELSE 200 END END AS status,
  CASE WHEN f.first IS NOT NULL THEN CASE WHEN e.event_type = 'error' THEN 'Server Error' ELSE 'OK ' || f.last END END AS status_text
FROM events e LEFT JOIN f ON f.first = e.event_id""")
def har_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = netlog.har_join(fx.requests(spark, sf_dir), fx.responses(spark, sf_dir))
    return out.select("seq", "status", "status_text")


_RULES = """
 r AS (SELECT CAST(p_partkey AS BIGINT) AS rule_no, CASE p_partkey % 6 WHEN 0 THEN 'https://api.example.com/*/' || p_partkey WHEN 1 THEN '*/error/' || p_partkey % 97
   WHEN 2 THEN 'https://api.example.com/click/' || p_partkey || '?' WHEN 3 THEN '*.example.com/[vp]*/' || p_partkey % 50 || '[0-4]' WHEN 4 THEN 'http://other.example.org/' || p_partkey || '*'
   ELSE 'https://*.example.com/[!ce]*/' || p_partkey END AS pattern FROM part)"""


def _url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per part: by start, by end, with single characters and classes."""
    pattern = (
        "CASE p_partkey % 6 WHEN 0 THEN concat('https://api.example.com/*/', p_partkey) WHEN 1 THEN concat('*/error/', p_partkey % 97) WHEN 2 THEN concat('https://api.example.com/click/', p_partkey, '?') "
        "WHEN 3 THEN concat('*.example.com/[vp]*/', p_partkey % 50, '[0-4]') WHEN 4 THEN concat('http://other.example.org/', p_partkey, '*') ELSE concat('https://*.example.com/[!ce]*/', p_partkey) END"
    )
    return table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS rule_no", f"{pattern} AS pattern")


@query("rule_matches", f"""
WITH {_RULES}, u AS (SELECT DISTINCT 'https://api.example.com/' || event_type || '/' || user_id AS url FROM events),
 m AS (SELECT u.url, rule_no FROM u JOIN r ON u.url GLOB r.pattern)
SELECT rule_no, count(*) AS n FROM events e JOIN m ON m.url = 'https://api.example.com/' || e.event_type || '/' || e.user_id GROUP BY rule_no""")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_counts(fx.requests(spark, sf_dir), _url_rules(spark, sf_dir))


@query("first_rules", f"""
WITH {_RULES}, u AS (SELECT DISTINCT 'https://api.example.com/' || event_type || '/' || user_id AS url FROM events),
 m AS (SELECT u.url, min(rule_no) AS rule_no FROM u JOIN r ON u.url GLOB r.pattern GROUP BY 1)
SELECT e.event_id AS seq, rule_no FROM events e LEFT JOIN m ON m.url = 'https://api.example.com/' || e.event_type || '/' || e.user_id""")
def first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_rule(fx.requests(spark, sf_dir), _url_rules(spark, sf_dir)).select("seq", "rule_no")


@query("action_numbers", """
SELECT event_id AS seq, row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 0), event_id % 2, event_id) - 1 AS action_no FROM events""")
def action_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "IF(event_id % 7 <> 0, value, NULL) AS ts")
    return netlog.numbered_actions(logs.where("seq % 2 = 0"), logs.where("seq % 2 = 1")).select("seq", "action_no")


class _Streaks:
    """Per user the longest run of one kind of event and when it began."""

    def __init__(self) -> None:
        self.user, self.kind, self.length, self.start, self.best = None, None, 0, None, (0, None, None)

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for user, kind, event in zip(*[batch.column(c).to_pylist() for c in ("user_id", "event_type", "event_id")], strict=True):
            if kind != self.kind:
                self.kind, self.length, self.start = kind, 0, event
            self.length += 1
            self.user = user
            if self.length > self.best[0]:
                self.best = (self.length, self.kind, self.start)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        length, kind, start = self.best
        yield pa.table({"user_id": pa.array([self.user], pa.int64()), "length": pa.array([length], pa.int64()), "kind": pa.array([kind], pa.string()), "start": pa.array([start], pa.int64())})


@query("event_streaks", """
WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events),
 r AS (SELECT user_id, event_type AS kind, min(event_id) AS start, count(*) AS length FROM n GROUP BY user_id, event_type, island)
SELECT user_id, length, kind, start FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1""")
def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return state.per_group(events, _Streaks, "user_id BIGINT, length BIGINT, kind STRING, start BIGINT", ["user_id"], ["event_id"])


@query("har_entries", """
SELECT event_id AS doc, 0 AS entry_no, 'https://api.example.com/' || event_type || '/' || user_id AS url, 'GET' AS method, props AS post_data, value AS ts, 200 AS status FROM events
UNION ALL SELECT event_id, 1, 'https://api.example.com/' || user_id, 'POST', NULL, NULL, NULL FROM events""")
def har_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = (
        "named_struct('url', concat('https://api.example.com/', event_type, '/', user_id), 'method', 'GET', 'headers', map('a', 'b'), "
        "'postData', props, 'timestamp', value, 'response', named_struct('status', 200, 'statusText', 'OK', 'headers', map('c', 'd')))"
    )
    other = "concat('{\"url\":\"https://api.example.com/', user_id, '\",\"method\":\"POST\"}')"
    doc = f"concat('{{\"log\":{{\"version\":\"1.2\",\"entries\":[', to_json({entry}), ',', {other}, ']}}}}')"
    docs = table(spark, sf_dir, "events").selectExpr("event_id AS doc", f"{doc} AS json")
    out = readers.har_entries(docs)
    return out.select("doc", F.col("entry_no").cast("bigint").alias("entry_no"), "url", "method", "post_data", "ts", "status")


@query("recording_actions", f"""
WITH {EV} SELECT event_id AS doc, 'https://a.example.com' AS start_url, unnest([0, 1]) AS action_no, unnest(['click', 'input']) AS type, unnest(['#b' || user_id, NULL]) AS selector, unnest([value, value + 1]) AS timestamp
FROM ev WHERE k % 4 <> 0""")
def recording_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = (
        "array(named_struct('type', 'click', 'selector', concat('#b', user_id), 'timestamp', value), "
        "named_struct('type', 'input', 'selector', CAST(NULL AS STRING), 'timestamp', value + 1))"
    )
    doc = f"IF(CAST(get_json_object(props, '$.k') AS BIGINT) % 4 = 0, '{{\"version\":\"1\"}}', to_json(named_struct('version', '1', 'startUrl', 'https://a.example.com', 'duration', value, 'actions', {actions})))"
    docs = table(spark, sf_dir, "events").selectExpr("event_id AS doc", f"{doc} AS json")
    out = readers.recording_actions(docs)
    return out.select("doc", "start_url", F.col("action_no").cast("bigint").alias("action_no"), "type", "selector", "timestamp")


@query("mock_override", """
SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 503 WHEN user_id % 10 = 7 THEN 200 END AS mock_status,
  CASE WHEN event_type = 'view' THEN 'down' WHEN user_id % 10 = 7 THEN '{"ok":1}' END AS mock_body,
  CASE WHEN event_type = 'view' OR user_id % 10 = 7 THEN 'application/json' END AS mock_type FROM events""")
def mock_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"pattern": "*/view/*", "status": 503, "body": "down"}, {"pattern": "*7", "body": '{"ok":1}'}]
    return netlog.mock_override(fx.requests(spark, sf_dir), rules).select("seq", "mock_status", "mock_body", "mock_type")


@query("security_headers", """
WITH r AS (SELECT event_id, user_id % 2 = 0 AS csp, user_id % 5 = 0 AS hsts, user_id % 3 = 0 AS frame FROM events)
SELECT event_id AS seq, 100 - 20 * (1 + CASE WHEN csp THEN 0 ELSE 1 END + CASE WHEN hsts THEN 0 ELSE 1 END + CASE WHEN frame THEN 0 ELSE 1 END) AS score,
  CASE WHEN csp THEN 'default-src' ELSE '' END AS csp,
  concat_ws('|', CASE WHEN NOT csp THEN 'Missing Content-Security-Policy header' END, CASE WHEN NOT hsts THEN 'Missing Strict-Transport-Security header (HSTS)' END,
    CASE WHEN NOT frame THEN 'Missing X-Frame-Options header (clickjacking protection)' END, 'Missing X-Content-Type-Options header') AS issues FROM r""")
def security_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.security_headers(fx.responses(spark, sf_dir).select("seq", "url", "headers"))
    return out.select("seq", "score", F.col("content_security_policy").alias("csp"), F.array_join("issues", "|").alias("issues"))


@query("web_vitals", """
SELECT 'https://app.example.com/e/' || event_id AS page_url, CAST(floor(value) AS BIGINT) * 10 AS ttfb, CASE WHEN event_type <> 'error' THEN value END AS fcp,
  CASE event_id % 3 WHEN 1 THEN value + 1 WHEN 2 THEN CASE WHEN value = 0 THEN value + 1 ELSE value END END AS lcp, 120 + CAST(floor(value) AS BIGINT) * 20 AS dom_content_loaded,
  200 + CAST(floor(value) AS BIGINT) * 50 AS load_complete, CAST(floor(value) AS BIGINT) AS transfer_size, 100 + CAST(floor(value) AS BIGINT) * 20 AS dom_interactive FROM events""")
def web_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.web_vitals(fx.timings(spark, sf_dir))


def _host_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals with the host, one of which has a third of them, and the hour of a navigation."""
    out = audit.web_vitals(fx.timings(spark, sf_dir)).withColumn("event_id", F.regexp_extract("page_url", r"/e/(\d+)$", 1).cast("bigint"))
    return out.selectExpr("IF(event_id % 3 = 0, 'hot', concat('h', event_id % 40)) AS host", "event_id DIV 1000 AS hour", *audit.VITALS)


@query("vitals_p75", """
WITH v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'h' || event_id % 40 END AS host, value AS lcp, CAST(floor(value) AS BIGINT) * 10 AS ttfb FROM events),
 m AS (SELECT host, 'ttfb' AS metric, CAST(ttfb AS DOUBLE) AS value FROM v)
SELECT host, metric, count(*) AS n, true AS within_bound FROM m GROUP BY host, metric""")
def vitals_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p75 per host from sketches per host and hour; held against the exact ranks of the value, one hundredth off at most."""
    rows = _host_vitals(spark, sf_dir)
    hourly = audit.vitals_sketches(rows, ["host", "hour"], metrics=["ttfb"])
    found = audit.vitals_quantile(audit.merged_sketches(hourly, ["host"]))
    ranks = rows.where("ttfb IS NOT NULL").join(found.select("host", "value"), "host").groupBy("host").agg(
        (F.count_if(F.col("ttfb") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("ttfb") <= F.col("value")) / F.count("*")).alias("upto")
    )
    return found.join(ranks, "host").select("host", "metric", "n", ((F.col("below") <= 0.76) & (F.col("upto") >= 0.74)).alias("within_bound"))


@query("vitals_p75_by_hour", """
WITH v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'h' || event_id % 40 END AS host, event_id // 1000 AS hour, CAST(200 + CAST(floor(value) AS BIGINT) * 50 AS DOUBLE) AS value FROM events)
SELECT host, hour, 'load_complete' AS metric, count(*) AS n, list_sort(list(value))[CAST(ceil(0.75 * count(*)) AS BIGINT)] AS value FROM v GROUP BY host, hour""")
def vitals_p75_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fewer values than the sketch holds are exact."""
    return audit.vitals_quantile(audit.vitals_sketches(_host_vitals(spark, sf_dir), ["host", "hour"], metrics=["load_complete"]))


@query("resource_summary", """
SELECT 'https://app.example.com/u/' || user_id AS page_url, CASE event_type WHEN 'click' THEN 'fetch' WHEN 'view' THEN 'img' WHEN 'error' THEN 'other' ELSE 'script' END AS initiator_type,
  count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2""")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.resource_summary(fx.requests(spark, sf_dir))


@query("performance_scores", """
WITH t AS (SELECT p_partkey, event_id, CAST(floor(value) AS BIGINT) AS v FROM part LEFT JOIN events ON event_id = p_partkey)
SELECT p_partkey AS page_id, 100 - CASE WHEN 200 + v * 50 > 3000 THEN 30 ELSE 0 END - CASE WHEN v * 10 > 600 THEN 20 ELSE 0 END AS performance,
  100 - CASE WHEN p_partkey % 2 = 1 THEN 25 ELSE 12 END AS accessibility FROM t""")
def performance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = audit.page_checks(fx.media_pages(spark, sf_dir)).withColumn("url", F.expr("concat('https://app.example.com/e/', page_id)"))
    return audit.performance_scores(checks, audit.web_vitals(fx.timings(spark, sf_dir)))


@query("memory_report", """
SELECT event_id, round((event_id + 1) * 4096 / 1048576.0, 2) AS heap_limit_mb, round((event_id + 1) * 1024 / 1048576.0, 2) AS heap_used_mb, CAST(25 AS DOUBLE) AS heap_usage_percent FROM events""")
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").selectExpr(
        "event_id", "(event_id + 1) * 4096 AS heap_limit", "(event_id + 1) * 2048 AS heap_total", "(event_id + 1) * 1024 AS heap_used"
    )
    return audit.memory_report(samples).select("event_id", "heap_limit_mb", "heap_used_mb", "heap_usage_percent")


@query("ws_summary", """
SELECT 'wss://live.example.com/' || user_id AS url, count(*) FILTER (event_type = 'click') AS sent, count(*) FILTER (event_type = 'view') AS received,
  count(*) FILTER (event_type IN ('click', 'view')) AS messages, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY user_id""")
def ws_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.ws_summary(fx.ws_messages(spark, sf_dir))


@query("ws_payloads", "SELECT event_id, left(repeat(props, 30), 200) AS payload FROM events")
def ws_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.ws_payloads(fx.ws_messages(spark, sf_dir), 200).select("event_id", "payload")


@query("attempt_outcome", f"""
WITH {EV}, a AS (SELECT event_id AS job_id, k % 6 + 1 AS need, event_type, k FROM ev)
SELECT job_id, CASE WHEN need <= 3 AND event_type <> 'error' THEN need ELSE 3 END AS attempts, need <= 3 AND event_type <> 'error' AS ok,
  CASE WHEN need <= 3 AND event_type <> 'error' THEN 'out ' || need || '/' || k END AS output, CASE WHEN NOT (need <= 3 AND event_type <> 'error') THEN 'failed 3' END AS last_error FROM a""")
def attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.attempt_outcome(fx.attempts(spark, sf_dir), 3)


@query("merged_actions", """
SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS source FROM events""")
def merged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.actions(spark, sf_dir).select("seq", "ts", "event_type")
    merged = netlog.merged_actions(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"))
    return merged.select("seq", F.col("source").cast("bigint").alias("source"))


@query("replay_delays", f"""
WITH {EV}, a AS (SELECT event_id AS seq, CAST(us // 1000 AS DOUBLE) AS t, lag(CAST(us // 1000 AS DOUBLE), 1, 0.0) OVER (PARTITION BY user_id ORDER BY us // 1000, event_id) AS before FROM ev)
SELECT seq, CASE WHEN t > before THEN (t - before) / 1000 / 2 ELSE 0 END AS delay FROM a""")
def replay_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.replay_delays(fx.actions(spark, sf_dir), 2.0).select("seq", "delay")


@query("session_history", f"""
WITH {EV}, v AS (SELECT event_id, user_id, 'https://app.example.com/' || event_type || '/' || k AS url FROM ev)
SELECT event_id AS seq, url, lag(url) OVER w AS back_url, lead(url) OVER w AS forward_url FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.session_history(fx.actions(spark, sf_dir)).select("seq", "url", "back_url", "forward_url")


GAP = 6 * 3600 * 1000000


@query("network_idle", f"""
WITH {EV}, s AS (SELECT *, CASE WHEN us - lag(us) OVER w < {GAP} THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS burst FROM s)
SELECT 'https://app.example.com/u/' || user_id AS page_url, min(us) AS start_us, max(us) + {GAP} AS idle_at_us, count(*) AS n FROM g GROUP BY user_id, burst""")
def network_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.network_idle(fx.requests(spark, sf_dir), GAP)


@query("record_actions", f"""
WITH {EV}, a AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, us, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'input' ELSE 'keypress' END AS type,
  CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN k % 4 = 0 THEN 'Enter' WHEN k % 4 = 1 THEN 'Shift' ELSE 'a' END AS key FROM ev),
 kept AS (SELECT * FROM a WHERE type <> 'keypress' OR key IN ('Enter', 'a'))
SELECT session_id, seq, type, key, us - min(us) OVER (PARTITION BY session_id) AS rel_us FROM kept""")
def record_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlog.record_actions(fx.actions(spark, sf_dir)).select("session_id", "seq", "type", "key", "rel_us")


@query("kv_fold", f"""
WITH {EV}, c AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS cleared FROM ev GROUP BY 1)
SELECT 's' || e.user_id AS store, 'k' || k % 10 AS key, arg_max(CAST(value AS VARCHAR), event_id) AS value FROM ev e JOIN c USING (user_id)
WHERE event_type <> 'signup' AND (cleared IS NULL OR event_id > cleared) GROUP BY 1, 2""")
def kv_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.kv_fold(fx.kv_ops(spark, sf_dir))


@query("cookie_fold", f"""
WITH {EV}, o AS (SELECT event_id, user_id, event_type, 'c' || k % 5 AS name, CASE WHEN k % 2 = 0 THEN '/' ELSE '/app' END AS path,
  CASE WHEN k % 3 = 0 THEN 'shop.example.com' ELSE 'u' || user_id % 3 || '.example.com:8080' END AS domain, CAST(value AS VARCHAR) AS value FROM ev),
 c AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS cleared FROM o GROUP BY 1)
SELECT 's' || o.user_id AS store, domain, path, name, arg_max(value, event_id) AS value FROM o JOIN c USING (user_id)
WHERE event_type <> 'signup' AND (cleared IS NULL OR event_id > cleared) AND name = 'c3' GROUP BY 1, 2, 3, 4""")
def cookie_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = fx.kv_ops(spark, sf_dir).selectExpr(
        "store", "seq", "op", "concat('c', k % 5) AS name", "IF(k % 2 = 0, '', '/app') AS path", "IF(k % 3 = 0, 'shop.example.com', '') AS domain",
        "concat('https://u', user_id % 3, '.example.com:8080/x') AS page_url", "value",
    )
    return state.kv_get(state.kv_fold(state.cookie_ops(ops), ["domain", "path", "name"]), "c3", "name")


@query("collect_until", f"""
WITH RECURSIVE {EV}, b AS (SELECT user_id AS s, us // 86400000000 - 19722 AS r, event_id AS pos, event_type || k % 12 AS item FROM ev),
 f AS (SELECT s, item, min(r) AS r, arg_min(pos, (r, pos)) AS pos FROM b GROUP BY s, item),
 cnt AS (SELECT s, r, count(*) AS n FROM f GROUP BY s, r), streams AS (SELECT DISTINCT s FROM b),
 walk AS (SELECT s, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS total, 0 AS flat FROM streams
   UNION ALL SELECT w.s, w.r + 1, w.total + coalesce(c.n, 0), CASE WHEN coalesce(c.n, 0) = 0 THEN w.flat + 1 ELSE 0 END
   FROM walk w LEFT JOIN cnt c ON c.s = w.s AND c.r = w.r + 1 WHERE w.flat < 3 AND w.total < 20 AND w.r < 400),
 ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.s ORDER BY f.r, f.pos, f.item) AS rn FROM f JOIN walk w ON w.s = f.s AND w.r = f.r)
SELECT s AS stream_id, item, r AS round, pos FROM ranked WHERE rn <= 20""")
def collect_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.collect_until(fx.scroll_batches(spark, sf_dir), 20).withColumn("round", F.col("round").cast("bigint"))


@query("collect_distinct", f"""
WITH {EV} SELECT DISTINCT user_id AS stream_id, event_type || k % 12 AS item FROM ev""")
def collect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fx.scroll_batches(spark, sf_dir).select("stream_id", "round", "item")
    odd, even = days.where("round % 2 = 1").drop("round"), days.where("round % 2 = 0").drop("round")
    return odd.union(even).distinct()


@query("set_difference", """
SELECT DISTINCT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id").distinct()
    return left.join(events.where("event_type = 'signup' AND value > 100").select("user_id").distinct(), "user_id", "left_anti")


@query("totals", "SELECT (SELECT count(*) FROM pages) AS total_pages, (SELECT count(DISTINCT url) FROM pages) AS total_urls, (SELECT count(*) FROM events) AS total_items")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").agg(F.count("*").alias("total_pages"), F.countDistinct("url").alias("total_urls"))
    items = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return pages.withColumn("total_items", items.scalar())


@query("parse_body", f"""
WITH {EV} SELECT event_id AS seq, CASE WHEN event_id % 4 <> 0 THEN k END AS k, CASE WHEN event_id % 4 = 0 THEN 'plain ' || k END AS text, event_type <> 'error' AS ok FROM ev""")
def parse_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.parse_body(fx.responses(spark, sf_dir))
    is_text = "schema_of_variant(data) = 'STRING'"
    return out.selectExpr("seq", "try_variant_get(data, '$.k', 'bigint') AS k", f"IF({is_text}, CAST(data AS STRING), NULL) AS text", "ok")


@query("basic_auth", """
SELECT c_custkey, 'Basic ' || to_base64(encode(c_name || ':' || c_mktsegment)) AS header FROM customer""")
def basic_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{state.basic_auth_header('c_name', 'c_mktsegment')} AS header")


@query("classify_error", """
WITH m AS (SELECT doc_id, lower(text || CASE doc_id % 8 WHEN 0 THEN ' net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN ' net::ERR_CONNECTION_REFUSED' WHEN 2 THEN ' net::ERR_PROXY_CONNECTION_FAILED'
   WHEN 3 THEN ' Timeout 30000ms' WHEN 4 THEN ' Element is not here' WHEN 5 THEN ' Chrome not found' ELSE '' END) AS msg FROM documents)
SELECT doc_id, CASE WHEN contains(msg, 'net::err_name_not_resolved') THEN 'Check if the URL is correct and the domain exists.'
  WHEN contains(msg, 'net::err_connection_refused') THEN 'The server refused the connection. Check if the URL and port are correct.'
  WHEN contains(msg, 'net::err_proxy_connection_failed') THEN 'Proxy connection failed. Check your --proxy setting.'
  WHEN contains(msg, 'timeout') THEN 'Try increasing --timeout or check if the page is accessible.'
  WHEN contains(msg, 'element') AND contains(msg, 'not') THEN 'Check if the selector is correct or use --wait-for to wait for the element.'
  WHEN contains(msg, 'chrome') AND contains(msg, 'not found') THEN 'Install Chrome or Chromium, or run: playwright install chromium' END AS advice FROM m""")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = "', ' net::ERR_NAME_NOT_RESOLVED', ' net::ERR_CONNECTION_REFUSED', ' net::ERR_PROXY_CONNECTION_FAILED', ' Timeout 30000ms', ' Element is not here', ' Chrome not found"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat(text, coalesce(get(array({ends[3:]}'), CAST(doc_id % 8 AS INT)), '')) AS msg")
    return docs.selectExpr("doc_id", f"{state.classify_error('msg')} AS advice")
