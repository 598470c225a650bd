"""Run bookkeeping and source health."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DRY_RUN_LIMIT
from ..schema import SourceSpec, local_frame, sources_frame
from .qualify import source_counts


def latest_source_status(source_runs: DataFrame) -> DataFrame:
    """The latest row per source, by id; one aggregate, no self join."""
    others = [c for c in source_runs.columns if c != "source"]
    latest = source_runs.groupBy("source").agg(
        F.max_by(F.struct(*others), "id").alias("last")
    )
    return latest.select("source", "last.*").select(*source_runs.columns).orderBy("source")


def last_run(runs: DataFrame) -> DataFrame:
    """The run that started last, as at most one row."""
    latest = runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r"))
    return latest.filter("r IS NOT NULL").select("r.*")


def run_ok(source_runs: DataFrame) -> DataFrame:
    """Per run: is every source ok or skipped?"""
    return source_runs.groupBy("run_id").agg(
        F.bool_and(F.col("status").isin("ok", "skipped")).alias("ok")
    )


def dry_run_preview(kept: DataFrame, limit: int = DRY_RUN_LIMIT) -> DataFrame:
    """The first kept reports in ingestion order."""
    return kept.orderBy("seq").limit(limit)


def drop_failed_sources(raw: DataFrame, failures: DataFrame) -> DataFrame:
    """A source with any failed payload contributes nothing; the others are untouched.

    `failures` has one row per failed payload (source, status, message). Its distinct
    sources are no more than the configured ones, which bounds the broadcast.
    """
    return raw.join(F.broadcast(failures.select("source").distinct()), "source", "left_anti")


def source_failures(failures: DataFrame) -> DataFrame:
    """One status and message per failed source: that of its first failed payload."""
    return failures.groupBy("source").agg(
        F.min_by(F.struct("status", "message"), "page_no").alias("first")
    ).select("source", "first.status", "first.message")


def source_runs(
    labelled: DataFrame,
    failures: DataFrame | None,
    specs: Sequence[SourceSpec],
    run_id: str,
    started_at: datetime,
    finished_at: datetime,
    only: Sequence[str] | None = None,
    first_id: int = 0,
) -> DataFrame:
    """The run's log rows, one per source run: status, counts and message.

    Ids count on from `first_id`, in configured order.
    """
    spark = labelled.sparkSession
    configured = sources_frame(spark, specs).filter("enabled")
    if only:
        configured = configured.filter(F.col("source").isin(*only))
    if failures is None:
        failures = local_frame(
            spark, [], "source STRING, page_no BIGINT, status STRING, message STRING"
        )
    counts = source_counts(labelled).withColumnRenamed("message", "dropped")
    joined = (
        configured.select("source", "source_ord")
        .join(counts, "source", "left")
        .join(source_failures(failures), "source", "left")
    )
    failed = F.col("status").isNotNull()
    return joined.select(
        (F.col("source_ord") + F.lit(first_id)).cast("bigint").alias("id"),
        F.lit(run_id).alias("run_id"),
        "source",
        F.coalesce(F.col("status"), F.lit("ok")).alias("status"),
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.when(failed, 0).otherwise(F.coalesce(F.col("fetched"), F.lit(0))).cast("bigint").alias("fetched"),
        F.when(failed, 0).otherwise(F.coalesce(F.col("kept"), F.lit(0))).cast("bigint").alias("kept"),
        F.when(failed, F.col("message")).otherwise(F.col("dropped")).alias("message"),
    )


def run_row(
    totals: DataFrame, run_id: str, started_at: datetime, finished_at: datetime
) -> DataFrame:
    """The run's own row: when, how many new, how many updated."""
    return totals.select(
        F.lit(run_id).alias("run_id"),
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.col("new_sales").cast("bigint").alias("new_sales"),
        F.col("updated_sales").cast("bigint").alias("updated_sales"),
    )


def source_listing(specs: Sequence[SourceSpec], log: DataFrame) -> DataFrame:
    """Configured sources with the outcome of their last run, in configured order."""
    dims = sources_frame(log.sparkSession, specs).select("source_ord", "source", "rank", "enabled")
    status = latest_source_status(log).select("source", "status", "fetched", "kept", "message")
    # One row per source that ever ran.
    return dims.join(status, "source", "left").orderBy("source_ord")


def health_summary(sales: DataFrame, runs: DataFrame, log: DataFrame) -> DataFrame:
    """Tracked sales, last run and latest status per source, in one row."""
    tracked = sales.agg(F.count(F.lit(1)).alias("tracked_sales"))
    run = last_run(runs).agg(F.first(F.struct(*runs.columns)).alias("last_run"))
    status = latest_source_status(log).agg(
        F.sort_array(F.collect_list(F.struct("source", "status", "fetched", "kept", "message"))).alias(
            "sources"
        )
    )
    return tracked.select(
        "*", run.scalar().alias("last_run"), status.scalar().alias("sources"), F.lit(True).alias("ok")
    )
