"""Facts out of prose: tags, prices, addresses, feed dates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    MONTHS,
    PROSE_ADDRESS_PATTERN,
    PROSE_PRICE_FLOOR,
    PROSE_PRICE_PATTERN,
)
from .amounts import parse_date, rewrite
from .text import blank_to_null, squeeze, strip


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    # The named-entity table has over two thousand entries and special cases;
    # the standard library's is used as it is.
    return text.map(html.unescape, na_action="ignore")


def strip_html(text: Column) -> Column:
    """Tags become blanks and entities characters."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    # Only texts with an ampersand travel to Python; others pass as nulls.
    has_entity = plain.contains("&")
    unescaped = F.when(has_entity, _unescape(F.when(has_entity, plain))).otherwise(plain)
    return F.regexp_replace(unescaped, "\u00a0", " ")


def extract_price(text: Column) -> Column:
    """The largest dollar figure at or above the floor; null when there is none."""
    pattern = F.lit("(?iU)" + PROSE_PRICE_PATTERN)
    numbers = F.regexp_extract_all(text, pattern, F.lit(1))
    suffixes = F.regexp_extract_all(text, pattern, F.lit(2))

    def amount(number: Column, suffix: Column) -> Column:
        word = F.lower(suffix)
        factor = (
            F.when(word.isin("million", "mil", "m"), 1e6)
            .when(word.isin("k", "thousand"), 1e3)
            .otherwise(1.0)
        )
        return F.rint(
            F.regexp_replace(number, ",", "").try_cast("double") * factor
        ).try_cast("bigint")

    amounts = F.zip_with(numbers, suffixes, amount)
    return F.array_max(F.filter(amounts, lambda a: a >= PROSE_PRICE_FLOOR))


def extract_address(text: Column) -> Column:
    """The first "number, capitalized words, street suffix" in a text."""
    found = squeeze(F.regexp_extract(text, "(?U)" + PROSE_ADDRESS_PATTERN, 1))
    return blank_to_null(F.regexp_replace(found, r"^[ .]+|[ .]+$", ""))


_MONTH = "(?=(?:" + "|".join(m + "|" + m[:3] for m in MONTHS) + r")[\s-])([a-z]{3})[a-z]*"
_RFC822_DAY = rf"(?i)^(?:(?:[a-z]+,|Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s*)?(\d{{1,2}})[\s-]+{_MONTH}[\s-]+"
_CLOCK = r"\s+\d{1,2}:\d{1,2}(?::\d{1,2})?(?:\s+\S.*)?$"
_RFC822_LAYOUTS = (
    (_RFC822_DAY + r"(\d{4})" + _CLOCK, "=$3-$2-$1"),
    (_RFC822_DAY + r"(69|[7-9]\d)" + _CLOCK, "=19$3-$2-$1"),
    (_RFC822_DAY + r"(\d{2})" + _CLOCK, "=20$3-$2-$1"),
)


def parse_feed_date(value: Column) -> Column:
    """RFC 822 date as written in its own offset, else any date `parse_date` knows."""
    written = F.try_to_date(rewrite(strip(value), _RFC822_LAYOUTS), "y-MMM-d")
    return F.coalesce(written, parse_date(value))
