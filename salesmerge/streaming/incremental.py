"""Incremental resolution: landed report files to the stored sales table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import DEDUPE_WINDOW_DAYS
from ..operators.resolve import resolve_events
from ..schema import REPORT_SCHEMA, SourceSpec
from ..session import stage
from ..sources.tables import committed_version, key_bucket, read_sales, table_buckets, write_sales


def check_order(batch: DataFrame, stored: DataFrame) -> None:
    """Fail if a report of a property doesn't come after the property's stored events.

    Order decides which report leads an event, so an older one would be merged wrongly.
    """
    first = batch.groupBy("property_key").agg(F.min("seq").alias("seq"))
    late = stored.join(first, "property_key").filter("seq <= event_seq").limit(1).collect()
    if late:
        raise ValueError(
            f"report {late[0]['seq']} of {late[0]['property_key']} doesn't come after the stored "
            "events: give the run a higher number"
        )


def stored_beside(
    reports: DataFrame, path: str, buckets: int, before: int | None = None
) -> tuple[list[int], DataFrame, DataFrame]:
    """The buckets that `reports` touch, their stored events of the same properties, and the others.

    `reports` is read more than once. With `before`, the events as they were before that version.
    """
    spark = reports.sparkSession
    # At most `buckets` values.
    touched = [r[0] for r in reports.select(key_bucket(buckets)).distinct().collect()]
    keys = reports.select("property_key", F.lit(True).alias("touched")).distinct()
    # The stored buckets are read and split once.
    stored = read_sales(spark, path, touched, before).join(keys, "property_key", "left")
    stored = stage(stored, "stored")
    concerned = stored.filter("touched").drop("touched")
    check_order(reports, concerned)
    return touched, concerned, stored.filter("touched IS NULL").drop("touched")


def apply_batch(
    batch: DataFrame,
    path: str,
    specs: Sequence[SourceSpec],
    window_days: int = DEDUPE_WINDOW_DAYS,
    buckets: int | None = None,
    batch_id: int | None = None,
    stream_id: str = "",
) -> None:
    """Resolve one batch of reports against the stored events and commit the result.

    A report's `seq` must exceed those of its property's stored events. Only buckets the batch
    touches are read and rewritten. A batch of a stream that was committed before is skipped, so
    a restarted stream applies each batch once, and another stream all of its own.
    """
    spark = batch.sparkSession
    if batch_id is not None and committed_version(spark, path, stream_id, batch_id) is not None:
        return
    reports = stage(batch, "batch")
    buckets = table_buckets(spark, path, buckets)
    touched, concerned, others = stored_beside(reports, path, buckets)
    if not touched:
        return
    resolved = resolve_events(reports, specs, window_days, stored=concerned)
    write_sales(resolved.unionByName(others), path, touched, buckets, batch_id, stream_id)


def incremental_resolve(
    spark: SparkSession,
    landed: str,
    path: str,
    specs: Sequence[SourceSpec],
    checkpoint: str,
    window_days: int = DEDUPE_WINDOW_DAYS,
    buckets: int | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Apply every report file not seen yet, then stop.

    The stream has the id that its checkpoint was made with, so one that begins anew, even at the
    same place, is another stream and applies all its files. All state is the sales table; the
    stream itself keeps none, so there is no watermark: a late report is judged by the run date
    when it qualifies.
    """
    reader = spark.readStream.schema(REPORT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def each(batch: DataFrame, batch_id: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        apply_batch(batch, path, specs, window_days, buckets, batch_id, stream_id)

    return (
        reader.parquet(landed)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
