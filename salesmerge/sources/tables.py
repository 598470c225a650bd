"""The stored sales table, append-only log tables, and CSV export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import COMMAND_EXPORT_COLUMNS, DEFAULT_STATE
from ..schema import SALE_SCHEMA, local_frame

BUCKETS = 64
_COMMIT_SCHEMA = (
    "version BIGINT, bucket INT, buckets INT, folder STRING, stream_id STRING, batch_id BIGINT"
)
_FILE_SCHEMA = T.StructType([*SALE_SCHEMA.fields, T.StructField("key_bucket", T.IntegerType())])


def key_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("property_key"), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """The commit rows, or None where no table has been written; any other error is raised."""
    try:
        return spark.read.schema(_COMMIT_SCHEMA).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_version(spark: SparkSession, path: str, stream_id: str, batch_id: int) -> int | None:
    """The version that this batch of this stream became; None if it hasn't been applied."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    own = commits.filter((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))
    return own.agg(F.min("version")).first()[0]


def table_buckets(spark: SparkSession, path: str, wanted: int | None = None) -> int:
    """The table's number of buckets; a new table takes `wanted`, an existing one must have it."""
    commits = _commits(spark, path)
    held = None if commits is None else commits.agg(F.max("buckets")).first()[0]
    if held is None:
        return wanted or BUCKETS
    if wanted is not None and wanted != held:
        raise ValueError(f"{path} has {held} buckets, not {wanted}")
    return held


def write_sales(
    sales: DataFrame,
    path: str,
    touched: Sequence[int] | None = None,
    buckets: int | None = None,
    batch_id: int | None = None,
    stream_id: str = "",
) -> int:
    """Write the rows of the touched buckets as a new version and commit it.

    Files of a version are complete before its commit rows name their folder, and readers go
    by the commits, so nobody sees half a batch. The folder is a new one each time, so a retry
    after a crash isn't in the way of what the crash left. Untouched buckets keep their files.
    `sales` must hold all rows of each touched bucket.
    """
    spark = sales.sparkSession
    buckets = table_buckets(spark, path, buckets)
    commits = _commits(spark, path)
    last = None if commits is None else commits.agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    folder = f"version={version}-{uuid.uuid4().hex}"
    rows = sales.select(*SALE_SCHEMA.fieldNames()).withColumn("key_bucket", key_bucket(buckets))
    (
        rows.hint("rebalance", "key_bucket")
        .sortWithinPartitions("key_bucket", "sale_date")
        .write.partitionBy("key_bucket")
        .parquet(f"{path}/data/{folder}")
    )
    touched = range(buckets) if touched is None else touched
    entries = [(version, int(b), buckets, folder, stream_id, batch_id) for b in touched]
    local_frame(spark, entries, _COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{path}/commits"
    )
    return version


def read_sales(
    spark: SparkSession,
    path: str,
    only_buckets: Sequence[int] | None = None,
    before: int | None = None,
) -> DataFrame:
    """The current rows: each bucket at its last committed version, or its last one `before` another.

    A committed version whose files are gone is an error, never fewer rows.
    """
    commits = _commits(spark, path)
    empty = spark.createDataFrame([], SALE_SCHEMA)
    if commits is None:
        return empty
    if only_buckets is not None:
        commits = commits.filter(F.col("bucket").isin(*only_buckets))
    if before is not None:
        commits = commits.filter(F.col("version") < before)
    # One row per bucket.
    current = commits.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()
    by_folder: dict[str, list[int]] = {}
    for row in current:
        by_folder.setdefault(row["folder"], []).append(row["bucket"])
    result = empty
    for folder, held in sorted(by_folder.items()):
        part = spark.read.schema(_FILE_SCHEMA).parquet(f"{path}/data/{folder}")
        rows = part.filter(F.col("key_bucket").isin(*held)).drop("key_bucket")
        result = rows if result is empty else result.unionByName(rows)
    now = F.current_timestamp()
    return result.withColumns(
        {
            "state": F.coalesce(F.nullif("state", F.lit("")), F.lit(DEFAULT_STATE)),
            "first_seen": F.coalesce("first_seen", now),
            "last_seen": F.coalesce("last_seen", now),
            "raw": F.coalesce("raw", F.lit("{}")),
        }
    )


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a run log table; none where it hasn't been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str) -> None:
    """Add a run's few rows to a log table, as one file: all of them or none."""
    rows.coalesce(1).write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] = COMMAND_EXPORT_COLUMNS) -> None:
    """CSV part files in row order: header, quoting by doubling, CRLF, empty nulls."""
    (
        rows.select(*columns)
        .write.options(header=True, lineSep="\r\n", escape='"', nullValue="", emptyValue="")
        .csv(path)
    )
