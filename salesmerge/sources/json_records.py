"""Any JSON payload that holds a list of records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import json_path, variant_kind
from .landed import failure, map_fields


def scan_json_records(payloads: DataFrame, records_path: str = "") -> tuple[DataFrame, DataFrame]:
    """Payloads to one row per record: (source, page_no, pos, record).

    The path leads to an array or to one record; members that aren't objects are
    skipped. A path that ends at a filled scalar fails the source.
    """
    parsed = payloads.select("source", "page_no", F.try_parse_json("body").alias("payload"))
    located = parsed.withColumn("found", json_path(F.col("payload"), records_path)).withColumn(
        "kind", variant_kind(F.col("found"))
    )
    spark = payloads.sparkSession
    many = (
        located.filter("kind = 'array'")
        .lateralJoin(spark.tvf.variant_explode(F.col("found").outer()))
        .select("source", "page_no", "pos", F.col("value").alias("record"))
    )
    one = located.filter("kind = 'object'").select(
        "source", "page_no", F.lit(0).alias("pos"), F.col("found").alias("record")
    )
    records = many.unionByName(one).filter(variant_kind(F.col("record")) == "object")
    text = F.try_variant_get("found", "$", "string")
    filled = F.col("kind").isin("string", "number", "boolean") & ~F.coalesce(
        text.isin("", "0", "false"), F.lit(True)
    )
    message = F.concat(
        F.col("source"),
        F.lit(f": records_path '{records_path}' did not resolve to a list (got "),
        F.col("kind"),
        F.lit(")"),
    )
    failures = located.filter(filled).select(*failure("misconfigured", message)).unionByName(
        parsed.filter("payload IS NULL").select(
            *failure("error", F.concat(F.col("source"), F.lit(": payload is not JSON")))
        )
    )
    return records, failures


def record_reports(
    records: DataFrame, field_map: Mapping[str, str], source_url: str | None = None
) -> DataFrame:
    """Records of one vendor to raw reports."""
    for needed in ("address", "price", "sale_date"):
        if needed not in field_map:
            raise ValueError(f"field_map needs {needed}")
    reports = map_fields(records, field_map)
    own = F.col("source_url") if "source_url" in field_map else F.lit(None)
    return reports.withColumn("source_url", F.coalesce(own, F.lit(source_url)).cast("string"))
