"""Nearest event of the same property within a tolerance in days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEDUPE_WINDOW_DAYS


def nearest_event(
    reports: DataFrame, events: DataFrame, window_days: int = DEDUPE_WINDOW_DAYS
) -> DataFrame:
    """Each report with `event_seq`, `event_date` and `distance` of its nearest event.

    Ties go to the earlier date, then to the older event; reports without an event in
    reach keep nulls. Events are filed under date buckets one window wide, so a report
    reads three buckets' worth of dates whatever the size of its property: of several
    events on one date only the oldest can win, and a bucket group holds at most
    3 x (window + 1) dates. The grouped side has one row per (property, bucket), so a
    large property is split by date already and by skew handling beyond that.
    """
    width = window_days + 1
    day = F.unix_date("sale_date")
    per_date = events.groupBy("property_key", day.alias("day")).agg(
        F.min("event_seq").alias("event_seq")
    )
    bucket = F.floor(F.col("day") / width)
    filed = (
        per_date.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        .groupBy("property_key", "bucket")
        .agg(F.collect_list(F.struct("day", "event_seq")).alias("near"))
    )
    keyed = reports.withColumns(
        {"_day": day, "bucket": F.floor(F.unix_date("sale_date") / width)}
    )
    joined = keyed.join(filed, ["property_key", "bucket"], "left")
    inside = F.filter("near", lambda e: F.abs(e["day"] - F.col("_day")) <= window_days)
    best = F.array_min(
        F.transform(
            inside,
            lambda e: F.struct(
                F.abs(e["day"] - F.col("_day")).alias("distance"),
                e["day"].alias("day"),
                e["event_seq"].alias("event_seq"),
            ),
        )
    )
    return (
        joined.withColumn("best", best)
        .withColumns(
            {
                "event_seq": F.col("best.event_seq"),
                "event_date": F.date_from_unix_date(F.col("best.day")),
                "distance": F.col("best.distance"),
            }
        )
        .select(*reports.columns, "event_seq", "event_date", "distance")
    )
