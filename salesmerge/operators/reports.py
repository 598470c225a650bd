"""From raw source records to usable reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_STATE
from ..functions.addresses import display_address, property_key, split_unit, title_case_address
from ..functions.amounts import parse_date, parse_date_number, parse_price, parse_price_number
from ..functions.places import normalize_zip
from ..functions.text import blank_to_null, strip
from ..schema import RAW_REPORT_SCHEMA, REPORT_SCHEMA, SourceSpec, ingest_seq, small_side, sources_frame

_NUMERIC = {"beds": "double", "baths": "double", "sqft": "bigint", "lot_acres": "double",
            "year_built": "int"}


def conform(raw: DataFrame) -> DataFrame:
    """Exactly the raw-report columns; unknown ones go, missing ones become null."""
    return raw.to(RAW_REPORT_SCHEMA)


def reports_union(
    frames: Iterable[DataFrame],
    specs: Sequence[SourceSpec],
    run_no: int = 0,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """One ordered stream of raw reports from all enabled sources.

    Every frame carries `source` and `record_ord` (place within its source). The
    result's `seq` orders by configured source position, then record. A constant
    county or municipality of a source fills in where a record names none.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for name in ("county", "municipality"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    dims = sources_frame(rows.sparkSession, specs).filter("enabled")
    if only:
        dims = dims.filter(F.col("source").isin(*only))
    dims = dims.select(
        "source", "source_ord", F.col("county").alias("_county"), F.col("municipality").alias("_place")
    )
    joined = rows.join(small_side(dims, len(specs)), "source")
    ordered = joined.withColumns(
        {
            "seq": ingest_seq(F.lit(run_no), F.col("source_ord"), F.col("record_ord")),
            "county": F.coalesce(blank_to_null(F.col("county")), F.col("_county")),
            "municipality": F.coalesce(blank_to_null(F.col("municipality")), F.col("_place")),
        }
    )
    return conform(ordered)


def optional_number(value: Column, kind: str) -> Column:
    """Number written with or without thousands commas; null when it is none."""
    number = F.regexp_replace(value.cast("string"), "[,$]", "").try_cast("double")
    return number if kind == "double" else F.rint(number).try_cast(kind)


def parse_reports(raw: DataFrame) -> DataFrame:
    """Conformed raw reports with parsed price and date and, where unusable, the reason."""
    parsed = raw.withColumns(
        {
            "address": strip(F.coalesce(F.col("address"), F.lit(""))),
            "price": F.when(F.col("price_num").isNotNull(), parse_price_number(F.col("price_num")))
            .otherwise(parse_price(F.col("price_text"))),
            "sale_date": F.when(
                F.col("sale_date_num").isNotNull(), parse_date_number(F.col("sale_date_num"))
            ).otherwise(parse_date(F.col("sale_date_text"))),
        }
    )
    return parsed.withColumn(
        "unusable",
        F.when(F.col("address") == "", "no_address")
        .when(F.col("price").isNull(), "no_price")
        .when(F.col("sale_date").isNull(), "no_date")
        .when(~F.col("address").rlike(r"(?U)\d"), "no_house_number"),
    )


def _parsed_once(parsed: DataFrame, keep: Column) -> DataFrame:
    """Filter on parsed columns without parsing twice.

    A plain filter would be pushed below the projection and repeat its expressions
    there; a generator over zero or one row of the parsed values evaluates each of them once.
    The other columns stay outside it, so unused ones are pruned and conditions reach the scan.
    """
    made = ["address", "price", "sale_date", "unusable"]
    rest = [c for c in parsed.columns if c not in made]
    found = parsed.select(
        *rest, F.inline(F.filter(F.array(F.struct(*made)), lambda r: r["unusable"].isNull() == keep))
    )
    return found.select(*parsed.columns)


def quarantine(raw: DataFrame) -> DataFrame:
    """The unusable records, whole, each with its reason."""
    return _parsed_once(parse_reports(raw), F.lit(False))


def usable_reports(raw: DataFrame) -> DataFrame:
    """Usable reports with parsed price, date and zip code; addresses aren't taken apart yet."""
    usable = _parsed_once(parse_reports(raw), F.lit(True))
    return usable.withColumn("zip_code", normalize_zip(F.col("zip_code")))


def finish_reports(usable: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """Usable reports in the fixed layout, each with the key of its property; an `area` stays.

    Taking addresses apart is the costliest part, so whoever drops reports by price, date or
    area does so before.
    """
    base, unit = split_unit(F.col("address"))
    split = usable.withColumns(
        {"base": base, "unit": F.coalesce(blank_to_null(F.col("unit")), unit, F.col("unit"))}
    )
    cased = split.withColumn("address", title_case_address(F.col("base")))
    shown = cased.withColumn("_shown", display_address(F.col("address"), F.col("unit")))
    seen = F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()
    finished = shown.withColumns(
        {
            "property_key": property_key(F.col("_shown"), F.col("zip_code"), F.col("municipality")),
            "state": F.coalesce(F.col("state"), F.lit(DEFAULT_STATE)),
            "area": F.col("area") if "area" in usable.columns else F.lit(None).cast("string"),
            "first_seen": seen,
            "last_seen": seen,
            **{name: optional_number(F.col(name), kind) for name, kind in _NUMERIC.items()},
        }
    )
    return finished.select(*REPORT_SCHEMA.fieldNames())


def build_report(raw: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """Usable reports in the fixed layout, each with the key of its property."""
    return finish_reports(usable_reports(raw), run_ts)
