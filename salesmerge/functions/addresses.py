"""Street addresses: unit split, comparison form, display form, property key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import DIRECTIONS, ORDINALS, STREET_TYPES, UNIT_WORDS
from .places import normalize_municipality, normalize_zip
from .text import first_match, let, squeeze, strip, word_map

def _unit_pattern(strict: bool) -> str:
    gap = r"(?:\.\s*|\s+)" if strict else r"\.?\s*"
    return rf"(?:\b(?:{'|'.join(UNIT_WORDS)}){gap}|#\s*)([A-Z0-9][A-Z0-9\-]*)\b"


def split_unit(address: Column, strict: bool = False) -> tuple[Column, Column]:
    """(address without its first unit designator, unit or null), in upper case.

    The designator word may touch the value ("FLORENCE" reads as FL + ORENCE);
    `strict` asks for a dot or blank between them.
    """
    text = strip(F.upper(F.coalesce(address, F.lit(""))))
    pattern = _unit_pattern(strict)
    # Anchored at both ends, so that only the first designator goes.
    rest = strip(F.regexp_replace(text, rf"(?Us)^(.*?){pattern}(.*)$", "$1 $3"))
    return rest, first_match(text, "(?U)" + pattern)


# No value of one list is a key of another, so one lookup replaces three.
_TOKEN_FORMS = {**ORDINALS, **DIRECTIONS, **STREET_TYPES}
_SHORT_DIRECTIONS = "|".join(DIRECTIONS.values())


def normalize_address(address: Column) -> Column:
    """Comparison form: one spelling per house, unit removed."""
    rest, _ = split_unit(address)
    text = F.replace(rest, F.lit("&"), F.lit(" AND "))
    text = F.regexp_replace(text, r"[^A-Z0-9\- ]+", " ")
    # Hyphens stay inside a token and go at its ends.
    text = F.regexp_replace(text, "-+(?![^ ])|-(?<![^ ]-)-*", "")
    text = F.trim(F.regexp_replace(text, " {2,}", " "))
    forms = word_map(_TOKEN_FORMS)
    tokens = F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(forms, t), t))
    # A trailing direction is noise while two other tokens remain.
    return F.regexp_replace(
        F.array_join(tokens, " "),
        rf"^(\S+ \S+(?: .*?)?)(?: (?:{_SHORT_DIRECTIONS}))+$",
        "$1",
    )


def title_case_address(address: Column) -> Column:
    """Display casing: words capitalized, directions and ordinals in upper case."""
    # Most addresses hold no such token; then one call does for the whole line.
    special = rf"(?iU)(?:^| )(?:{_SHORT_DIRECTIONS}|\d+(?:ST|ND|RD|TH))(?: |$)"

    def token(word: Column) -> Column:
        upper = F.upper(word)
        keep = upper.isin(*DIRECTIONS.values()) | upper.rlike(r"(?U)^\d+(ST|ND|RD|TH)$")
        return F.when(keep, upper).otherwise(F.initcap(word))

    return let(
        squeeze(F.coalesce(address, F.lit(""))),
        lambda text: F.when(
            text.rlike(special), F.array_join(F.transform(F.split(text, " "), token), " ")
        ).otherwise(F.initcap(text)),
    )


def display_address(address: Column, unit: Column) -> Column:
    return F.when(
        F.coalesce(unit, F.lit("")) != "", F.concat(address, F.lit(" #"), unit)
    ).otherwise(address)


def property_key(address: Column, zip_code: Column, municipality: Column) -> Column:
    """20 hex digits naming a physical property; units of one house differ."""
    _, unit = split_unit(address)
    place = F.coalesce(normalize_zip(zip_code), normalize_municipality(municipality))
    text = F.concat(
        normalize_address(address), F.lit("|"), F.coalesce(unit, F.lit("")), F.lit("|"), place
    )
    return F.substring(F.sha1(text.cast("binary")), 1, 20)
