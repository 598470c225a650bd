"""The order-free variant of event resolution: date islands as events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEDUPE_WINDOW_DAYS
from ..schema import REPORT_SCHEMA, SourceSpec
from .resolve import rank_lookup

_NOT_FILLED = ("seq", "property_key", "sale_date", "source", "raw", "first_seen", "last_seen")


def _blank(value: Column, kind: str) -> Column:
    return value.isNull() | (value == ("" if kind == "string" else 0))


def sessionize_events(
    reports: DataFrame, specs: Sequence[SourceSpec], window_days: int = DEDUPE_WINDOW_DAYS
) -> DataFrame:
    """Qualified reports to one row per property and run of dates without a larger gap.

    The highest-ranked report leads, the earliest of equal ranks; each other field comes from the
    best report that has a value. Nothing depends on the order of arrival, so it is one shuffle and
    no replay. Results differ from `resolve_events` where a chain of reports spans more than the
    window, or where an event moved before the next report came.
    """
    ranked = rank_lookup(reports, specs)
    # Half a day more than the window: a gap of just the window joins, one of a day more doesn't.
    session = F.session_window(F.col("sale_date").cast("timestamp"), f"{window_days * 24 + 12} hours")
    order = F.struct("rank", -F.col("seq"))
    fields = {
        f.name: f.dataType.typeName()
        for f in REPORT_SCHEMA.fields
        if f.name in reports.columns and f.name not in _NOT_FILLED
    }
    best = [
        F.max_by(name, F.struct(~F.coalesce(_blank(F.col(name), kind), F.lit(True)), "rank", -F.col("seq"))).alias(name)
        for name, kind in fields.items()
    ]
    grouped = ranked.groupBy("property_key", session).agg(
        F.min("seq").alias("event_seq"),
        F.min("sale_date").alias("first_date"),
        F.max("sale_date").alias("last_date"),
        F.count(F.lit(1)).alias("reports"),
        F.max_by("sale_date", order).alias("sale_date"),
        F.max_by("source", order).alias("source"),
        *best,
    )
    return grouped.drop("session_window")
