"""Positions in a global order, counted per partition and carried on by offsets: no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import checkpointed

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row in it below


def with_offsets(df: DataFrame, sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``df`` with ``offset_``: how many rows stand in the pieces before its own.

    ``sizes`` has a row per piece (``keys`` in their order, ``size``).  Pieces are partitions or file splits, so the list is as long as
    the job has tasks; one task sums it up and every task gets it.
    """
    before = F.sum(size).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, F.coalesce(before, F.lit(0)).cast("bigint").alias("offset_"))
    return df.join(F.broadcast(offsets), keys)


def numbered(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``df`` with its rows' 0-based position in ``order``.

    The rows are dealt out by ranges of the order and sorted there, so a task holds one range; what the other ranges hold is one
    number each.  Rows that are equal in ``order`` get different positions in any sequence.
    """
    # the place in the input splits a run of equal rows that is too long for one range
    ranged = df.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*order, "tie_").sortWithinPartitions(*order, "tie_").drop("tie_")
    stored = checkpointed(ranged.withColumn("place_", F.monotonically_increasing_id())).withColumn("piece_", F.shiftright("place_", 33))
    sizes = stored.groupBy("piece_").agg(F.count("*").alias("n_"))
    return with_offsets(stored, sizes, ["piece_"], "n_").withColumn(name, F.col("offset_") + F.col("place_").bitwiseAND(F.lit(_WITHIN))).drop("place_", "piece_", "offset_")
