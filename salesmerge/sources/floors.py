"""Price and date floors at the source."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_pushdown(
    landed: DataFrame,
    price_field: str,
    date_field: str,
    min_price: int,
    since: date,
    encoding: str = "date",
    extra: Column | None = None,
) -> DataFrame:
    """Keep rows at or above the floors, comparing the stored columns themselves.

    The date bound is written in the column's own encoding (date, timestamp, string
    or epoch_ms), so that the comparison needs no conversion and reaches the scan.
    """
    start = datetime(since.year, since.month, since.day, tzinfo=timezone.utc)
    bounds = {
        "date": F.lit(since),
        "timestamp": F.lit(start.replace(tzinfo=None)).cast("timestamp_ntz"),
        "string": F.lit(since.isoformat()),
        "epoch_ms": F.lit(int(start.timestamp() * 1000)),
    }
    kept = landed.filter((F.col(price_field) >= min_price) & (F.col(date_field) >= bounds[encoding]))
    return kept if extra is None else kept.filter(extra)
