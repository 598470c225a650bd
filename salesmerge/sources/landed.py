"""Landed files as payload rows, and mapping of JSON records to report fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ADDRESS_OBJECT_KEYS
from ..functions.paths import json_path, variant_kind
from ..functions.text import blank_to_null
from ..schema import PAGE_RECORD_BITS, RAW_REPORT_SCHEMA, RECORD_BITS, page_record_ord


def read_landed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files `<folder>/<source>/<page number>.<anything>` as payload rows.

    A file whose name doesn't begin with a page number that fits becomes a failure row.
    """
    files = spark.read.text(f"{folder}/*/*", wholetext=True)
    path = F.col("_metadata.file_path")
    found = files.select(
        *[value.alias(name) for name, value in landed_page(path).items()],
        F.regexp_extract(path, r"([^/]*)$", 1).alias("file"),
        F.col("value").alias("body"),
    )
    named = F.coalesce(F.col("page_no") < (1 << (RECORD_BITS - PAGE_RECORD_BITS)), F.lit(False))
    message = F.concat("source", F.lit(": no page number in file name "), "file")
    return (
        found.filter(named).drop("file"),
        found.filter(~named).select(*failure("misconfigured", message)),
    )


def landed_page(path: Column) -> dict[str, Column]:
    """Source and page number out of a file's path; no page number without leading digits."""
    return {
        "source": F.regexp_extract(path, r"([^/]+)/[^/]*$", 1),
        "page_no": F.regexp_extract(path, r"/(\d+)[^/]*$", 1).try_cast("bigint"),
    }


def failure(status: str, message: Column) -> list[Column]:
    return ["source", "page_no", F.lit(status).alias("status"), message.alias("message")]


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    return F.when(variant_kind(value) == "number", F.try_variant_get(value, "$", "double"))


def as_written(value: Column) -> Column:
    """Text of a value that is neither a number nor a truth value."""
    return F.when(~variant_kind(value).isin("number", "boolean", "null"), as_text(value))


def address_text(value: Column) -> Column:
    """An address string, or the first filled line of an address object."""
    lines = [
        blank_to_null(F.try_variant_get(value, f"$.{key}", "string")) for key in ADDRESS_OBJECT_KEYS
    ]
    return F.when(variant_kind(value) == "object", F.coalesce(*lines)).otherwise(as_text(value))


def map_fields(
    records: DataFrame, field_map: Mapping[str, str], nested: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw-report columns out of `record` (a VARIANT) by a target -> path map.

    Unknown targets are ignored. `nested` paths are dotted; otherwise a name is one
    flat key, dots included. Blank values count as absent. Records without a `record_ord` are
    ordered by page and position.
    """
    record = F.col("record")

    def at(path: str) -> Column:
        if nested:
            return json_path(record, path)
        quote = '"' if "'" in path else "'"
        return F.try_variant_get(record, f"$[{quote}{path}{quote}]", "variant")

    columns: dict[str, Column] = {}
    for target, path in field_map.items():
        value = at(path)
        if target in ("price", "sale_date"):
            columns[f"{target}_num"] = as_number(value)
            columns[f"{target}_text"] = as_written(value)
        elif target == "address":
            columns["address"] = address_text(value) if nested else as_text(value)
        elif target == "zip_code":
            # 19087 is a zip, 19087.0 is not; as text both would read alike.
            whole = (variant_kind(value) != "number") | (F.schema_of_variant(value) == "BIGINT")
            columns["zip_code"] = F.when(whole, blank_to_null(as_text(value)))
        elif target in RAW_REPORT_SCHEMA.fieldNames():
            columns[target] = blank_to_null(as_text(value))
    counted = "record_ord" in records.columns
    order = F.col("record_ord") if counted else page_record_ord(F.col("page_no"), F.col("pos"))
    return records.select(
        "source",
        order.alias("record_ord"),
        *keep,
        *[c.alias(name) for name, c in columns.items()],
        F.to_json(record).alias("raw"),
    )
