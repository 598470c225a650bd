"""Labelling reports with the most specific configured area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import normalize_county, normalize_municipality
from ..schema import Area, local_frame, small_side


def area_signals(
    spark: SparkSession, areas: Sequence[Area]
) -> dict[str, dict[str, tuple[int, str]]]:
    """Per kind of signal, the first area that claims each value.

    Priority is configuration order with sub-county areas before county-wide ones;
    a sub-county area is never matched by county. Only the configuration's own rows
    pass through here.
    """
    ordered = [a for a in areas if a.is_specific] + [a for a in areas if not a.is_specific]
    rows = []
    for priority, area in enumerate(ordered):
        rows += [("zip", z, priority, area.name) for z in area.zips]
        rows += [("municipality", m, priority, area.name) for m in area.municipalities]
        if not area.is_specific:
            rows += [("county", c, priority, area.name) for c in area.counties]
    frame = local_frame(spark, rows, "kind STRING, value STRING, priority INT, area STRING")
    value = (
        F.when(F.col("kind") == "municipality", normalize_municipality(F.col("value")))
        .when(F.col("kind") == "county", normalize_county(F.col("value")))
        .otherwise(F.col("value"))
    )
    claims: dict[str, dict[str, tuple[int, str]]] = {"zip": {}, "municipality": {}, "county": {}}
    for row in frame.withColumn("value", value).collect():
        if row["value"]:
            claims[row["kind"]].setdefault(row["value"], (row["priority"], row["area"]))
    return claims


def match_area(
    reports: DataFrame, areas: Sequence[Area], where: Column | None = None
) -> DataFrame:
    """Set `area` on each report: by zip, municipality or county, most specific first.

    Three equality joins against small dimensions, no condition with OR. Rows
    outside `where` get no area and skip the name normalization.
    """
    spark = reports.sparkSession
    claims = area_signals(spark, areas)
    wanted = F.lit(True) if where is None else where
    keyed = reports.withColumns(
        {
            "_zip": F.when(wanted, F.col("zip_code")),
            "_municipality": F.when(wanted, normalize_municipality(F.col("municipality"))),
            "_county": F.when(wanted, normalize_county(F.col("county"))),
        }
    )
    for kind, by_value in claims.items():
        rows = [(value, *claim) for value, claim in by_value.items()]
        side = local_frame(spark, rows, f"_{kind} STRING, priority INT, area STRING").select(
            f"_{kind}", F.struct("priority", "area").alias(f"_{kind}_claim")
        )
        keyed = keyed.join(small_side(side, len(rows)), f"_{kind}", "left")
    best = F.least(*[F.col(f"_{kind}_claim") for kind in claims])
    return keyed.withColumn("area", best["area"]).select(*_with(reports.columns, "area"))


def _with(columns: list[str], name: str) -> list[str]:
    return columns if name in columns else [*columns, name]
