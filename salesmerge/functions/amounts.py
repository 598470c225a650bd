"""Prices and dates out of text and JSON numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import EPOCH_MILLIS_ABOVE, MONTHS, PRICE_PATTERN, PRICE_SUFFIXES
from .text import let, strip


def whole_dollars(amount: Column) -> Column:
    """Nearest whole dollar (ties to even); null unless positive."""
    return let(F.rint(amount).try_cast("bigint"), lambda price: F.when(price > 0, price))


def parse_price_number(value: Column) -> Column:
    return whole_dollars(value.cast("double"))


def parse_price(text: Column) -> Column:
    """"$1,250,000", "1.25M", "1250000.00" -> whole dollars, else null."""
    pattern = "(?iU)" + PRICE_PATTERN
    number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(",")).try_cast("double")
    factors = F.create_map(*[F.lit(x) for w, n in PRICE_SUFFIXES.items() for x in (w, float(n))])
    factor = F.try_element_at(factors, F.upper(F.regexp_extract(text, pattern, 2)))
    return whole_dollars(number * F.coalesce(factor, F.lit(1.0)))


_EPOCH_END = 253402300800  # first second of year 10000


def parse_date_number(value: Column) -> Column:
    """Epoch seconds, or milliseconds when large, as the UTC date."""
    number = value.cast("double")
    seconds = F.when(number > EPOCH_MILLIS_ABOVE, number / 1000.0).otherwise(number)
    days = F.when(
        (number > 0) & (seconds < _EPOCH_END), F.floor(seconds / 86400.0).cast("int")
    )
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


_TIME = r"(?:2[0-3]|[01]\d|\d):(?:[0-5]\d|\d):(?:6[01]|[0-5]\d|\d)"
_OFFSET = r"(?:[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
_ISO_TIME = (
    r"(?:(?s:.)(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:,\d+)?)?)?" + _OFFSET + ")?"
)
_YEAR = r"((?!0000)\d{4})"

# Numeric layouts, each rewritten to "=year-month-day". The mark keeps a text that
# no layout fits from being taken for a date, and a fitted one from a second layout.
_LAYOUTS = (
    (rf"^{_YEAR}-(\d{{1,2}})-(\d{{1,2}})(?:(?:T|\s+){_TIME})?$", "=$1-$2-$3"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_YEAR}$", "=$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(69|[7-9]\d)$", "=19$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "=20$3-$1-$2"),
    (rf"^{_YEAR}/(\d{{1,2}})/(\d{{1,2}})$", "=$1-$2-$3"),
    (rf"^{_YEAR}-?(\d{{2}})-?(\d{{2}}){_ISO_TIME}$", "=$1-$2-$3"),
)
_MONTH_WORDS = "|".join(m + "|" + m[:3] for m in MONTHS)
_NAMED_LAYOUTS = (
    (rf"(?i)^(?=(?:{_MONTH_WORDS})\s)([a-z]{{3}})[a-z]*\s+(\d{{1,2}}),\s+{_YEAR}$", "=$3-$1-$2"),
    (rf"(?i)^(\d{{1,2}})\s+(?=(?:{'|'.join(MONTHS)})\s)([a-z]{{3}})[a-z]*\s+{_YEAR}$", "=$3-$2-$1"),
)
_WEEK = rf"^{_YEAR}-?W(0[1-9]|[1-4]\d|5[0-3])(?:-?([1-7]))?{_ISO_TIME}$"


def rewrite(text: Column, layouts: tuple[tuple[str, str], ...]) -> Column:
    """The rewritten text of the first layout that fits, else the empty text."""
    for pattern, layout in layouts:
        text = F.regexp_replace(text, pattern, layout)
    return F.regexp_extract(text, "^=(.*)$", 1)


def _iso_week_date(text: Column) -> Column:
    week = F.regexp_extract(text, _WEEK, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, _WEEK, 3).try_cast("int"), F.lit(1))
    # Week 1 holds January 4th; a week 53 the year lacks falls into the next year.
    fourth = F.concat(F.regexp_extract(text, _WEEK, 1), F.lit("-01-04")).try_cast("date")
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (week - 1) * 7)
    return F.when(F.weekofyear(monday) == week, F.date_add(monday, day - 1))


def parse_date(text: Column) -> Column:
    """A date out of the layouts sources use; null when none fits."""
    cleaned = strip(F.substring_index(F.replace(strip(text), F.lit("Z")), ".", 1))
    return (
        F.when(text.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
        .when(text.rlike("(?i)[a-z]{3}"), F.try_to_date(rewrite(cleaned, _NAMED_LAYOUTS), "y-MMM-d"))
        .when(text.contains("W"), _iso_week_date(cleaned))
        .when(text.rlike(r"(?U)^\s*\d{10,}\s*$"), parse_date_number(strip(text).try_cast("double")))
        .otherwise(rewrite(cleaned, _LAYOUTS).try_cast("date"))
    )
