"""Shared text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything that counts as blank, so that both ends can be trimmed without a regex.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
# (?U) gives \s, \d, \w and \b their Unicode meaning. Single spaces stay untouched.
_UNEVEN_BLANKS = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]"


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends (Spark's trim knows only the space)."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return F.trim(F.regexp_replace(text, _UNEVEN_BLANKS, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group, never an empty one, of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a costly value, so that using it several times computes it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
