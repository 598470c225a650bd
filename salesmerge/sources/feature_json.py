"""Feature-service query pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FEATURE_OPTIONAL_FIELDS
from ..functions.paths import variant_kind
from .landed import failure, map_fields


def scan_feature_json(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to one row per feature: (source, page_no, pos, record, latitude, longitude).

    Features without attributes are skipped. The point is kept only when its y is a
    number. A page that isn't JSON or carries an `error` fails its source.
    """
    pages = payloads.select("source", "page_no", F.try_parse_json("body").alias("page"))
    page = F.col("page")
    error = F.try_variant_get(page, "$.error", "variant")
    features = pages.filter(page.isNotNull() & error.isNull()).withColumn(
        "features", F.try_variant_get(page, "$.features", "variant")
    )
    spark = payloads.sparkSession
    exploded = features.lateralJoin(
        spark.tvf.variant_explode(F.col("features").outer())
    ).select("source", "page_no", "pos", F.col("value").alias("feature"))
    feature = F.col("feature")
    y = F.try_variant_get(feature, "$.geometry.y", "variant")
    is_point = variant_kind(y) == "number"
    rows = exploded.select(
        "source",
        "page_no",
        "pos",
        F.try_variant_get(feature, "$.attributes", "variant").alias("record"),
        F.when(is_point, F.try_variant_get(feature, "$.geometry.y", "double")).alias("latitude"),
        F.when(is_point, F.try_variant_get(feature, "$.geometry.x", "double")).alias("longitude"),
    ).filter(
        (variant_kind(F.col("record")) == "object")
        & (F.schema_of_variant("record") != "OBJECT<>")
    )
    details = F.try_variant_get(error, "$.details", "array<string>")
    message = F.concat(
        F.col("source"),
        F.lit(": "),
        F.trim(
            F.concat_ws(
                " ",
                F.try_variant_get(error, "$.message", "string"),
                F.array_join(F.coalesce(details, F.array()), "; "),
            )
        ),
    )
    failures = pages.filter(error.isNotNull()).select(*failure("misconfigured", message)).unionByName(
        pages.filter(page.isNull()).select(
            *failure("error", F.concat(F.col("source"), F.lit(": page is not JSON")))
        )
    )
    return rows, failures


def feature_reports(
    features: DataFrame,
    price_field: str,
    date_field: str,
    field_map: Mapping[str, str],
    source_url: str | None = None,
) -> DataFrame:
    """Features of one layer to raw reports."""
    if "address" not in field_map:
        raise ValueError("field_map needs the layer's address column")
    wanted = {t: field_map[t] for t in ("address", *FEATURE_OPTIONAL_FIELDS) if t in field_map}
    wanted |= {"price": price_field, "sale_date": date_field}
    return map_fields(features, wanted, nested=False, keep=("latitude", "longitude")).withColumn(
        "source_url", F.lit(source_url).cast("string")
    )


