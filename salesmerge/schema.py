"""Record layouts and the two small configuration dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Text as a source wrote it, before parsing. Price and date keep the number a
# JSON source sent apart from text, because the two parse differently.
RAW_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("price_text", T.StringType()),
        T.StructField("price_num", T.DoubleType()),
        T.StructField("sale_date_text", T.StringType()),
        T.StructField("sale_date_num", T.DoubleType()),
        T.StructField("county", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("parcel_id", T.StringType()),
        T.StructField("buyer", T.StringType()),
        T.StructField("seller", T.StringType()),
        T.StructField("beds", T.StringType()),
        T.StructField("baths", T.StringType()),
        T.StructField("sqft", T.StringType()),
        T.StructField("lot_acres", T.StringType()),
        T.StructField("year_built", T.StringType()),
        T.StructField("property_type", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# One usable report of one transaction by one source.
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("property_key", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("county", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("sale_date", T.DateType()),
        T.StructField("parcel_id", T.StringType()),
        T.StructField("buyer", T.StringType()),
        T.StructField("seller", T.StringType()),
        T.StructField("beds", T.DoubleType()),
        T.StructField("baths", T.DoubleType()),
        T.StructField("sqft", T.LongType()),
        T.StructField("lot_acres", T.DoubleType()),
        T.StructField("year_built", T.IntegerType()),
        T.StructField("property_type", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)

# One merged row per transaction: the report columns plus the event's identity.
SALE_SCHEMA = T.StructType(
    [T.StructField("event_id", T.StringType()), T.StructField("event_seq", T.LongType())]
    + [field for field in REPORT_SCHEMA.fields if field.name != "seq"]
)

SOURCE_RUN_SCHEMA = (
    "id BIGINT, run_id STRING, source STRING, status STRING, started_at TIMESTAMP, "
    "finished_at TIMESTAMP, fetched BIGINT, kept BIGINT, message STRING"
)
RUN_SCHEMA = (
    "run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
    "new_sales BIGINT, updated_sales BIGINT"
)

START_SCHEMA = "run_no BIGINT, run_id STRING, started_at TIMESTAMP"

# Bits of the ingestion order: run number, then source position, then record.
RUN_BITS = 13
SOURCE_BITS = 7
RECORD_BITS = 43
PAGE_RECORD_BITS = 17

# Largest configuration dimension that is sent to every executor.
MAX_BROADCAST_ROWS = 100_000


def within(value: Column, bits: int, what: str) -> Column:
    """The number as it is, or an error if it needs more bits: packed orders never collide."""
    value = value.cast("bigint")
    message = F.concat(F.lit(f"{what} doesn't fit in {bits} bits: "), value.cast("string"))
    fits = value.isNull() | ((value >= 0) & (value < (1 << bits)))
    return F.when(fits, value).otherwise(F.raise_error(message).cast("bigint"))


def ingest_seq(run_no: Column, source_ord: Column, record_ord: Column) -> Column:
    """Ingestion order as one comparable BIGINT: run, source, record in source.

    A number that doesn't fit its share fails the job.
    """
    return (
        F.shiftleft(within(run_no, RUN_BITS, "run number"), SOURCE_BITS + RECORD_BITS)
        + F.shiftleft(within(source_ord, SOURCE_BITS, "source position"), RECORD_BITS)
        + within(record_ord, RECORD_BITS, "record position")
    )


def page_record_ord(page_no: Column, position: Column) -> Column:
    """Position of a record within its source: landed page, then place on the page."""
    page = within(page_no, RECORD_BITS - PAGE_RECORD_BITS, "page number")
    return F.shiftleft(page, PAGE_RECORD_BITS) + within(position, PAGE_RECORD_BITS, "place on a page")


@dataclass(frozen=True)
class Area:
    """A geography to keep; listing places or zips makes it a sub-county area."""

    name: str
    counties: Sequence[str] = ()
    municipalities: Sequence[str] = ()
    zips: Sequence[str] = ()

    @property
    def is_specific(self) -> bool:
        return bool(self.municipalities or self.zips)


@dataclass(frozen=True)
class SourceSpec:
    """A configured source; its place in the configured list is its order."""

    name: str
    rank: int = 0
    enabled: bool = True
    county: str | None = None
    municipality: str | None = None


def local_frame(spark: SparkSession, rows: Sequence[tuple], fields: str) -> DataFrame:
    """A small table held in the plan itself, so that its exact size is known to Spark."""
    schema = to_arrow_schema(T.StructType.fromDDL(fields))
    records = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=schema))


def sources_frame(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    rows = [
        (ord_, s.name, s.rank, s.enabled, s.county, s.municipality)
        for ord_, s in enumerate(specs)
    ]
    return local_frame(
        spark,
        rows,
        "source_ord INT, source STRING, rank INT, enabled BOOLEAN, county STRING, municipality STRING",
    )


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a join side whose row count is known and small; else a plain join."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df
