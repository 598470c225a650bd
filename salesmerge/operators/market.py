"""Statistics per area and month, from quantile sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import key_bucket

#: Size of a sketch: exact up to so many sales, then a rank error of about 0.03 per cent.
SKETCH_SIZE = 8192


def bucket_sketches(sales: DataFrame, buckets: int, size: int = SKETCH_SIZE) -> DataFrame:
    """(key_bucket, area, month, n, volume, prices): one pass, combined before the shuffle.

    A run that rewrites a bucket of the sales table replaces just this bucket's rows.
    """
    month = F.date_format("sale_date", "yyyy-MM")
    return sales.groupBy(key_bucket(buckets).alias("key_bucket"), "area", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("price").alias("volume"),
        F.kll_sketch_agg_bigint("price", F.lit(size)).alias("prices"),
    )


def area_month_stats(sketches: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(area, month, n, volume, median_price) by area and month, by area, and for all sales.

    `month` is null for an area's total, `area` too for the total of all; `level` is 0, 1 and 2.
    The sales aren't read. A median is the lower of the middle two, within the sketch's error.
    """
    merged = sketches.rollup("area", "month").agg(
        F.grouping_id().alias("grouping"),
        F.sum("n").alias("n"),
        F.sum("volume").alias("volume"),
        F.kll_merge_agg_bigint("prices", F.lit(size)).alias("prices"),
    )
    level = F.when(F.col("grouping") == 0, 0).when(F.col("grouping") == 1, 1).otherwise(2)
    return merged.select(
        level.alias("level"), "area", "month", "n", "volume",
        F.kll_sketch_get_quantile_bigint("prices", F.lit(0.5)).alias("median_price"),
    )
