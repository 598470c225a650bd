"""Questions over the merged sales."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    COMMAND_EXPORT_COLUMNS,
    LISTABLE_COLUMNS,
    MIN_PRICE,
    QUERY_LIMIT,
)
from ..functions.addresses import display_address

NEWEST_FIRST = (F.desc, "sale_date"), (F.desc, "price"), (F.asc, "event_id")
# Up to here a top-k is merged in one task; beyond, a page is bounded by its first and last keys.
TOP_K_ROWS = 10_000
# Price intervals that are counted at once.
BINS = 1024


def _newest_first() -> list[Column]:
    return [direction(name) for direction, name in NEWEST_FIRST]


def search_sales(sales: DataFrame, text: str) -> DataFrame:
    """Sales whose address, municipality, buyer or seller holds the text, any case."""
    wanted = F.lower(F.lit(text))
    hit = F.lit(False)
    for name in ("address", "municipality", "buyer", "seller"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), wanted), F.lit(False))
    return sales.filter(hit)


def filter_sales(
    sales: DataFrame,
    *,
    min_price: int | None = None,
    since: date | None = None,
    area: str | None = None,
    county: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Apply the given conditions; plain column comparisons, so they reach the scan."""
    if min_price is not None:
        sales = sales.filter(F.col("price") >= min_price)
    if since is not None:
        sales = sales.filter(F.col("sale_date") >= F.lit(since))
    if area:
        sales = sales.filter(F.col("area") == area)
    if county:
        sales = sales.filter(F.col("county") == county)
    return search_sales(sales, search) if search else sales


def newest_first(sales: DataFrame, limit: int = QUERY_LIMIT, offset: int = 0) -> DataFrame:
    """The page of the newest sales: by date, then price, then event id."""
    if limit + offset <= TOP_K_ROWS:
        ordered = sales.orderBy(*_newest_first())
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    return _long_page(sales, limit, offset)


def _place(counts: Sequence[tuple], rank: int) -> tuple | None:
    """Of (value, n) in order, the value that holds the row of this rank, and its rank in there."""
    for value, n in counts:
        if rank < n:
            return value, n, rank
        rank -= n
    return None


def _key_at(sales: DataFrame, rank: int) -> tuple | None:
    """(sale_date, price, event_id) of the row with this rank, newest first; None beyond the last.

    Counting narrows the rows down to a few: by date, then by price interval, then by the first
    characters of the id. Each step reads the columns it needs of the rows that are left, and
    returns as many counts as there are dates or bins.
    """
    by_date = sales.groupBy("sale_date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("sale_date"))
    found = _place([tuple(r) for r in by_date.collect()], rank)
    if found is None:
        return None
    day, n, rank = found
    left = sales.filter(F.col("sale_date") == F.lit(day))
    low, high = None, None
    while n > TOP_K_ROWS and (low is None or low < high):
        if low is None:
            low, high = left.agg(F.min("price"), F.max("price")).first()
        width = (high - low) // BINS + 1
        number = F.floor((F.col("price") - F.lit(low)) / F.lit(width))
        bins = left.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin"))
        chosen, n, rank = _place([tuple(r) for r in bins.collect()], rank)
        low, high = low + chosen * width, min(high, low + (chosen + 1) * width - 1)
        left = left.filter(F.col("price").between(low, high))
    prefix = ""
    while n > TOP_K_ROWS:  # one price
        longer = F.substring("event_id", 1, len(prefix) + 2)
        heads = left.groupBy(longer.alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy("head")
        head, n, rank = _place([tuple(r) for r in heads.collect()], rank)
        if head == prefix:
            break  # equal ids
        prefix, left = head, left.filter(F.col("event_id").startswith(head))
    few = left.select("sale_date", "price", "event_id").orderBy(*_newest_first())
    return tuple(few.offset(rank).limit(1).first())


def _from(key: tuple) -> Column:
    """Rows at this key or behind it."""
    day, price, event_id = (F.lit(value) for value in key)
    same_day, same_price = F.col("sale_date") == day, F.col("price") == price
    return (F.col("sale_date") < day) | (
        same_day & ((F.col("price") < price) | (same_price & (F.col("event_id") >= event_id)))
    )


def _until(key: tuple) -> Column:
    """Rows at this key or before it."""
    day, price, event_id = (F.lit(value) for value in key)
    same_day, same_price = F.col("sale_date") == day, F.col("price") == price
    return (F.col("sale_date") > day) | (
        same_day & ((F.col("price") > price) | (same_price & (F.col("event_id") <= event_id)))
    )


def _long_page(sales: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of any length at any offset: its first and last keys are found by counting.

    Only the page's own rows are sorted, in parallel, and nothing is written. Keys are unique.
    """
    first = _key_at(sales, offset) if limit else None
    if first is None:
        return sales.limit(0)
    last = _key_at(sales, offset + limit - 1)
    page = sales.filter((F.col("sale_date") <= F.lit(first[0])) & _from(first))
    if last is not None:
        page = page.filter((F.col("sale_date") >= F.lit(last[0])) & _until(last))
    return page.orderBy(*_newest_first())


def query_sales(
    sales: DataFrame, *, limit: int = QUERY_LIMIT, offset: int = 0, **conditions
) -> DataFrame:
    """Filtered sales, newest first."""
    return newest_first(filter_sales(sales, **conditions), limit, offset)


def count_sales(
    sales: DataFrame, min_price: int | None = None, since: date | None = None
) -> DataFrame:
    """How many sales pass the floors, as one row."""
    kept = filter_sales(sales, min_price=min_price, since=since)
    return kept.agg(F.count(F.lit(1)).alias("n"))


def distinct_values(sales: DataFrame, column: str) -> DataFrame:
    """The non-blank values of a listable column, sorted."""
    if column not in LISTABLE_COLUMNS:
        raise ValueError(f"cannot list values of column {column!r}")
    value = F.col(column)
    return (
        sales.filter(value.isNotNull() & (value != ""))
        .select(value.alias("value"))
        .distinct()
        .orderBy("value")
    )


def market_stats(shown: DataFrame, sales: DataFrame, min_price: int = MIN_PRICE) -> DataFrame:
    """Count, median price and volume of the shown sales, and all tracked ones.

    The median of an even count is the floored mean of the middle two. `shown` is a
    limited page, which bounds the exact percentile.
    """
    cards = shown.agg(
        F.count(F.lit(1)).alias("matching"),
        F.floor(F.percentile("price", F.lit(0.5))).cast("bigint").alias("median_price"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("bigint").alias("total_volume"),
    )
    tracked = count_sales(sales, min_price=min_price).scalar()
    return cards.select("*", tracked.alias("tracked"))


def money(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 0)), F.lit("--"))


def pretty_date(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MMM d, yyyy"), F.lit(""))


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != 0)


def _plain_number(value: Column) -> Column:
    """A number as text without a needless ".0"."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def presentation(sales: DataFrame) -> DataFrame:
    """The display columns of a sales listing."""
    place = F.concat_ws(
        " ",
        F.when(
            (F.coalesce(F.col("municipality"), F.lit("")) != "")
            & (F.coalesce(F.col("county"), F.lit("")) != ""),
            F.concat(F.col("municipality"), F.lit(","))
        ).otherwise(F.nullif(F.col("municipality"), F.lit(""))),
        F.when(F.col("county") != "", F.concat(F.col("county"), F.lit(" County"))),
        F.nullif(F.col("zip_code"), F.lit("")),
    )
    details = F.concat_ws(
        " · ",
        F.when(_present(F.col("beds")), F.concat(F.col("beds").cast("bigint").cast("string"), F.lit(" bd"))),
        F.when(_present(F.col("baths")), F.concat(_plain_number(F.col("baths")), F.lit(" ba"))),
        F.when(_present(F.col("sqft")), F.concat(F.format_number("sqft", 0), F.lit(" sqft"))),
        F.when(_present(F.col("lot_acres")), F.concat(_plain_number(F.col("lot_acres")), F.lit(" ac"))),
        F.when(_present(F.col("year_built")), F.concat(F.lit("built "), F.col("year_built").cast("string"))),
    )
    return sales.select(
        "event_id",
        pretty_date(F.col("sale_date")).alias("sold"),
        money(F.col("price")).alias("price"),
        display_address(F.col("address"), F.col("unit")).alias("property"),
        place.alias("place"),
        F.coalesce(F.col("area"), F.lit("")).alias("area"),
        details.alias("details"),
        F.coalesce(F.col("buyer"), F.lit("")).alias("buyer"),
        F.coalesce(F.col("seller"), F.lit("")).alias("seller"),
        "source",
        "source_url",
    )


def export_rows(
    sales: DataFrame, columns: Sequence[str] = COMMAND_EXPORT_COLUMNS
) -> DataFrame:
    """The exported columns, in export order."""
    return sales.select(*columns)
