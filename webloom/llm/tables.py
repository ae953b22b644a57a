"""Intermediate tables of long jobs."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from webloom.session import checkpointed


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more, by the file system that holds them."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, and the shuffle files behind it given back.

    Spark deletes the shuffle files of a finished job once the driver's garbage collector has met the job's plan, which
    may take long on a driver with little to do; so both collectors are asked for a round.
    """
    out = checkpointed(df, codec)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
