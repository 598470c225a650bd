"""The qualification filter and its accounting."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LOOKBACK_DAYS, MIN_PRICE, REJECT_REASONS
from ..schema import Area
from .areas import match_area
from .reports import finish_reports, usable_reports


def label_reports(
    reports: DataFrame,
    areas: Sequence[Area],
    today: date,
    min_price: int = MIN_PRICE,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """Reports with their area and, when they don't qualify, the first failing rule."""
    early = (
        F.when(F.col("price") < min_price, "below_price")
        .when(F.col("sale_date") < F.lit(today - timedelta(days=lookback_days)), "too_old")
        .when(F.col("sale_date") > F.lit(today + timedelta(days=1)), "future_date")
    )
    checked = reports.withColumn("reject_reason", early)
    labelled = match_area(checked, areas, where=F.col("reject_reason").isNull())
    return labelled.withColumn(
        "reject_reason",
        F.coalesce(F.col("reject_reason"), F.when(F.col("area").isNull(), "outside_area")),
    )


def qualify(labelled: DataFrame) -> DataFrame:
    """The reports to keep."""
    return labelled.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def kept_reports(
    raw: DataFrame,
    areas: Sequence[Area],
    today: date,
    run_ts: datetime | None = None,
    min_price: int = MIN_PRICE,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """Conformed raw reports to the finished reports to keep; addresses of others aren't taken apart."""
    labelled = label_reports(usable_reports(raw), areas, today, min_price, lookback_days)
    return finish_reports(qualify(labelled), run_ts)


def reject_counts(labelled: DataFrame) -> DataFrame:
    """Rejected reports per source and reason."""
    return (
        labelled.filter(F.col("reject_reason").isNotNull())
        .groupBy("source", "reject_reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def source_counts(labelled: DataFrame) -> DataFrame:
    """Per source: fetched, kept, and the message that accounts for the difference."""
    counted = labelled.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("reject_reason").isNull()).alias("kept"),
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REJECT_REASONS],
    )
    parts = [
        F.when(F.col(r) > 0, F.concat(F.lit(f"{r}="), F.col(r).cast("string")))
        for r in sorted(REJECT_REASONS)
    ]
    message = F.when(
        F.col("kept") < F.col("fetched"),
        F.concat(F.lit("dropped: "), F.concat_ws(", ", *parts)),
    )
    return counted.select("source", "fetched", "kept", message.alias("message"))
