"""State folded from logs: key/value stores, items collected over rounds, element-wise differences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from webloom.functions.sqltext import lit
from webloom.operators.skew import hot_keys, salted_join


def kv_fold(ops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(store, key columns, value): latest value per key after the last clear of its store.

    ``ops`` is (store, seq, op, key…, value) with op 'set' or 'clear'.  Clears are one row per store, values one aggregate per
    key, so a busy store or key is reduced before it moves.
    """
    keys = keys or ["key"]
    sets = ops.where("op = 'set'").groupBy("store", *keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    clears = ops.where("op = 'clear'").groupBy("store").agg(F.max("seq").alias("cleared"))
    live = salted_join(sets, clears, "store", keys, hot_keys(ops, "store")).where("cleared IS NULL OR seq > cleared")
    return live.select("store", *keys, "value")


def cookie_ops(ops: DataFrame) -> DataFrame:
    """Cookie operations with the key columns filled in: path '/' and the host of ``page_url`` when not given."""
    host = "regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
    return ops.withColumn("path", F.expr("coalesce(nullif(path, ''), '/')")).withColumn("domain", F.expr(f"coalesce(nullif(domain, ''), {host})"))


def kv_get(state: DataFrame, name: str, column: str = "key") -> DataFrame:
    return state.where(F.col(column) == F.lit(name))


def collect_until(batches: DataFrame, max_items: int | None = None, flat_rounds: int = 3) -> DataFrame:
    """(stream_id, item, round, pos): distinct items over the rounds of a stream.

    Collecting stops after ``flat_rounds`` rounds in a row without a new item, or once ``max_items``, if given, are
    there; items count in the order (round, pos) of their first appearance.  ``batches`` is (stream_id, round, pos, item); rounds count
    from 1 and a round without items still counts.
    """
    first = batches.where("item IS NOT NULL").groupBy("stream_id", "item").agg(F.min(F.struct("round", "pos")).alias("f"))
    first = first.select("stream_id", "item", "f.round", "f.pos")
    fresh = first.groupBy("stream_id", "round").agg(F.count("*").alias("n"))
    # rounds with new items, and how long nothing new came after each
    after = Window.partitionBy("stream_id").orderBy("round")
    gaps = fresh.withColumn("before", F.lag("round", 1, 0).over(after)).withColumn("flat", F.col("round") - F.col("before") > flat_rounds)
    reached = gaps.withColumn("stopped", F.max(F.col("flat").cast("int")).over(after.rowsBetween(Window.unboundedPreceding, 0)))
    reached = reached.withColumn("had", F.sum("n").over(after) - F.col("n"))
    if max_items is None:
        return first.join(reached.where("stopped = 0").select("stream_id", "round"), ["stream_id", "round"]).select("stream_id", "item", "round", "pos")
    open_rounds = reached.where((F.col("stopped") == 0) & (F.col("had") < max_items)).select("stream_id", "round", "had")
    # a round never gives more than max_items, so its rows are cut to that before anything is joined
    within = Window.partitionBy("stream_id", "round").orderBy("pos", "item")
    ranked = first.withColumn("rn", F.row_number().over(within)).where(F.col("rn") <= max_items)
    kept = ranked.join(open_rounds, ["stream_id", "round"])
    return kept.where(F.col("had") + F.col("rn") <= max_items).select("stream_id", "item", "round", "pos")


def array_diff_pct(pairs: DataFrame, a: str, b: str, threshold: float = 0.1) -> DataFrame:
    """Pairs with difference_percentage (share of unequal components, two decimals), images_match and error.

    Arrays of different sizes are an error.
    """
    differs = f"size(filter(zip_with({a}, {b}, (p, q) -> p <> q), d -> d))"
    same_size = f"size({a}) = size({b})"
    pct = f"IF({same_size}, {differs} * 100.0D / greatest(size({a}), 1), NULL)"
    out = pairs.withColumn("pct_", F.expr(pct))
    return out.withColumns(
        {
            "difference_percentage": F.round("pct_", 2),
            "images_match": F.col("pct_") < threshold * 100,
            "error": F.expr(f"IF({same_size}, NULL, concat('Images have different sizes: ', size({a}), ' vs ', size({b})))"),
        }
    ).drop("pct_")


def wcag_contrast(df: DataFrame, fg: str, bg: str) -> DataFrame:
    """``df`` with contrast_ratio (two decimals) and the four WCAG flags; a colour is the first three integers of its text."""
    def luminance(color: str) -> str:
        parts = f"transform(regexp_extract_all({color}, {lit(r'\d+')}, 0), n -> CAST(n AS DOUBLE) / 255)"
        linear = f"transform({parts}, c -> IF(c <= 0.03928D, c / 12.92D, power((c + 0.055D) / 1.055D, 2.4D)))"
        weights = "array(0.2126D, 0.7152D, 0.0722D)"
        total = f"aggregate(zip_with(slice({linear}, 1, 3), {weights}, (c, w) -> c * w), 0D, (s, v) -> s + v)"
        return f"IF({color} RLIKE '[0-9]', {total}, 0D)"

    out = df.withColumn("l1_", F.expr(luminance(fg))).withColumn("l2_", F.expr(luminance(bg)))
    out = out.withColumn("r_", (F.greatest("l1_", "l2_") + 0.05) / (F.least("l1_", "l2_") + 0.05))
    return out.withColumns(
        {
            "contrast_ratio": F.round("r_", 2),
            "wcag_aa": F.col("r_") >= 4.5,
            "wcag_aaa": F.col("r_") >= 7,
            "wcag_aa_large": F.col("r_") >= 3,
            "wcag_aaa_large": F.col("r_") >= 4.5,
        }
    ).drop("l1_", "l2_", "r_")


def parse_body(df: DataFrame, column: str = "body", status: str = "status") -> DataFrame:
    """``df`` with data VARIANT (the JSON, else the raw text) and ok (status 200 to 299)."""
    return df.withColumn("data", F.expr(f"coalesce(try_parse_json({column}), CAST({column} AS VARIANT))")).withColumn(
        "ok", F.col(status).between(200, 299)
    )


def basic_auth_header(user: str, password: str) -> str:
    """Authorization header value from a user and a password column, as SQL text."""
    return f"concat('Basic ', base64(CAST(concat({user}, ':', {password}) AS BINARY)))"


# Texts looked for in a lower-case failure message, in this order, and the advice each one gives.
ERROR_ADVICE = [
    (["net::err_name_not_resolved"], "Check if the URL is correct and the domain exists."),
    (["net::err_connection_refused"], "The server refused the connection. Check if the URL and port are correct."),
    (["net::err_proxy_connection_failed"], "Proxy connection failed. Check your --proxy setting."),
    (["timeout"], "Try increasing --timeout or check if the page is accessible."),
    (["element", "not"], "Check if the selector is correct or use --wait-for to wait for the element."),
    (["chrome", "not found"], "Install Chrome or Chromium, or run: playwright install chromium"),
]


def classify_error(message: str) -> str:
    """Advice for a failure message as SQL text, NULL when no rule fits; the first rule that fits wins."""
    rules = " ".join(
        f"WHEN {' AND '.join(f'contains(lower({message}), {lit(w)})' for w in words)} THEN {lit(advice)}" for words, advice in ERROR_ADVICE
    )
    return f"CASE {rules} END"


def eval_expr(df: DataFrame, *expressions: str) -> DataFrame:
    """User expressions over a table, as Spark SQL text."""
    return df.selectExpr(*expressions)


def map_pages(pages: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any per-batch pandas function over pages; the slow path, for what the operators cannot say."""
    return pages.mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def per_group(df: DataFrame, handler: type, schema: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows that a user's class makes of every group of ``df``, the rows of a group in order; for what no aggregate or window says.

    ``handler`` is a table function over Arrow: one object per group, ``eval`` gets its rows as record batches one after the other, ``terminate``
    ends it, both yield Arrow tables with the columns of ``schema``.  A group streams through one task and is never held as a whole, so
    its size costs time, not memory.
    """
    return arrow_udtf(handler, returnType=schema)(df.asTable().partitionBy(*by).orderBy(*order))
