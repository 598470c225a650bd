"""Municipalities, counties and zip codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import PLACE_CLASS_WORDS
from .text import first_match, squeeze, strip

_CLASS = "|".join(PLACE_CLASS_WORDS)


def normalize_municipality(name: Column) -> Column:
    """ "Radnor Township", "RADNOR TWP" and "Radnor" become RADNOR."""
    text = F.upper(F.coalesce(name, F.lit("")))
    text = F.trim(F.regexp_replace(text, r"(?U)[.,\s\x1c-\x1f]+", " "))
    text = F.regexp_replace(text, rf"(?U)^(?:{_CLASS})\s+OF\s+", "")
    return squeeze(F.regexp_replace(text, rf"(?U)\b(?:{_CLASS})\b", " "))


def normalize_county(name: Column) -> Column:
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"(?U)\bCOUNTY\b", " ")
    return squeeze(F.regexp_replace(text, r"(?U)[^A-Z\s\x1c-\x1f]", " "))


def normalize_zip(value: Column) -> Column:
    """Five digits, a +4 part dropped and a lost leading zero restored; else null."""
    padded = F.regexp_replace(strip(value.cast("string")), r"(?U)^(\d{4})$", "0$1")
    return first_match(padded, r"(?U)^(\d{5})(?:-\d{4})?$")
