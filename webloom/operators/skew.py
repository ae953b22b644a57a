"""Joins and running values that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import checkpointed

ROWS = 1_000_000  # rows of one key that a task should get at most
LISTED = 1_000_000  # keys in the list that is broadcast; with ROWS rows each that is a table of 10^12 rows


def hot_keys(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """(key, salts): values with more than ``rows`` rows and the number of tasks to spread each over.

    One partial aggregate over the keys.  The list is as long as the table has times ``rows``, and never longer than
    LISTED: beyond that only the most frequent keys are spread.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > rows)
    return counts.orderBy(F.desc("n_")).limit(LISTED).select(key, F.ceil(F.col("n_") / rows).cast("int").alias("salts_"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str | list[str], hot: DataFrame | None = None, how: str = "left", rows: int = ROWS) -> DataFrame:
    """Join on ``key`` with the hot keys of ``left`` spread over tasks of about ``rows`` rows; ``right`` has one row per key.

    Only the hot rows of ``right`` are copied.  The list of hot keys is written once, so ``left`` is read once for it, and
    its length is bounded (``hot_keys``), so it is broadcast.  ``left`` should be a written or cheap table.
    """
    hot = checkpointed(hot_keys(left, key, rows) if hot is None else hot).withColumnRenamed(key, "hot_")
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    columns = [spread_by] if isinstance(spread_by, str) else spread_by
    salt = F.when(F.col("hot_").isNotNull(), F.pmod(F.hash(*columns), F.col("salts_"))).otherwise(0)
    salted = left.join(hot, F.col(key) == F.col("hot_"), "left").withColumn("salt_", salt).drop("hot_", "salts_")
    last = F.when(F.col("hot_").isNotNull(), F.col("salts_") - 1).otherwise(0)
    copies = right.join(hot, F.col(key) == F.col("hot_"), "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), last))).drop("hot_", "salts_")
    return salted.join(copies, [key, "salt_"], how).drop("salt_")


def previous_value(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``value`` of the row before, per key, NULL at the start.

    Rows are looked at per (keys, bucket); only the first row of a bucket reads the last value of the bucket
    before, which comes from one summary row per bucket.  ``bucket`` must not decrease along ``order``.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    last = df.groupBy(*keys, bucket).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last_"))
    carried = last.withColumn("carry_", F.lag("last_").over(Window.partitionBy(*keys).orderBy(bucket))).drop("last_")
    rows = df.withColumn("rn_", F.row_number().over(inner)).withColumn("lag_", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    joined = rows.join(carried, [*keys, bucket])
    return joined.withColumn(name, F.when(F.col("rn_") == 1, F.col("carry_.v")).otherwise(F.col("lag_.v"))).drop("rn_", "lag_", "carry_")


def next_value(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the row after, per key, NULL at the end; the mirror image of previous_value."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*[F.col(o).desc() for o in order])
    first = df.groupBy(*keys, bucket).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("first_"))
    carried = first.withColumn("carry_", F.lead("first_").over(Window.partitionBy(*keys).orderBy(bucket))).drop("first_")
    rows = df.withColumn("rn_", F.row_number().over(inner)).withColumn("lead_", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    joined = rows.join(carried, [*keys, bucket])
    return joined.withColumn(name, F.when(F.col("rn_") == 1, F.col("carry_.v")).otherwise(F.col("lead_.v"))).drop("rn_", "lead_", "carry_")


def running_max(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Largest ``value`` so far per key, NULLs ignored, in two levels like previous_value."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = df.groupBy(*keys, bucket).agg(F.max(value).alias("top_"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = top.withColumn("carry_", F.max("top_").over(before)).drop("top_")
    rows = df.withColumn("run_", F.max(value).over(inner))
    joined = rows.join(carried, [*keys, bucket])
    return joined.withColumn(name, F.greatest("run_", "carry_")).drop("run_", "carry_")
