"""Session helper and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SPREAD = "webloom.spread"  # tasks over which the queries of ``plans`` deal out small tables before they parse them


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over as many tasks as the session asks for; as it is where it asks for nothing.

    The test tables are files of one row group, which a scan reads in one task whatever cores there are.  A session over data with enough
    splits leaves the setting out, and nothing is moved.
    """
    tasks = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


DEALT_ROWS = 20_000  # rows of a table from which documents are written that a task gets at most


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """A narrow table whose rows become whole documents, dealt out over the cores before they do.

    Its files are small beside the documents, so a scan by bytes would leave all of them to a few tasks.  Tasks grow in number with the
    rows, so none of them grows; the session's setting is the least.  ``by``: columns whose equal values stay in one task.
    """
    spark = df.sparkSession
    least = int(spark.conf.get(SPREAD, None) or 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-df.count() // DEALT_ROWS)), *by)


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(SPREAD, str(spark.sparkContext.defaultParallelism))
    return spark


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where the setting is missing on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = context.applicationId
        folder = _OWN_FOLDERS.setdefault(app, "") or tempfile.mkdtemp(prefix="webloom-checkpoint-")
        _OWN_FOLDERS[app] = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def bucketed(df: DataFrame, key: str, buckets: int | None = None, name: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in buckets of ``key``, and the table's name; with ``name`` the rows are added to that table.

    Joins and aggregates on ``key`` with as many shuffle partitions as there are buckets (spark.sql.shuffle.partitions by default) read it
    where it lies, without an exchange.  The caller forgets the name when it is done; files stay for the frames that read them.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fresh = name is None
    name = name or f"webloom_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    if fresh:
        writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    else:
        writer.mode("append").saveAsTable(name)
    return spark.table(name), name


def forget(spark: SparkSession, *names: str) -> None:
    """Takes the names of ``bucketed`` tables out of the catalog; their files lie outside it."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def checkpointed(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, computes every row once, and gives the planner a real size.
    ``codec`` is Parquet's, for tables whose size on disk matters more than the time to write them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
