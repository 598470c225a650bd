"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; safe to apply to a running session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Rows dealt by property are joined by (property, date bin) and merged without another shuffle.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster.

    Only a local session may fall back to a temporary folder: on a cluster an
    executor's own disk disappears with the executor.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="salesmerge-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Later passes then read only the columns they need, and a lost executor costs
    a re-read instead of a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task before heavy per-row work.
TASK_ROWS = 500_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table of few scan tasks over tasks of bounded size, and all cores, before heavy per-row work.

    A file with one row group is read by one task. A table whose scan already has enough tasks,
    whatever its files, passes unchanged; rows and results are the same either way. The rows of
    a Parquet table are counted by its footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)
