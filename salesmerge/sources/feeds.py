"""RSS and Atom documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prose import strip_html
from ..functions.text import blank_to_null, strip
from ..schema import PAGE_RECORD_BITS, page_record_ord, within
from .landed import failure

ITEM_FIELDS = "title string, description string, link string, pubDate string, `dc:date` string"
ENTRY_FIELDS = (
    "title string, summary string, content string, "
    "link array<struct<_href string>>, updated string, published string"
)
_ITEM, _ENTRY = (f"array<struct<{fields}>>" for fields in (ITEM_FIELDS, ENTRY_FIELDS))
_DOCUMENT = f"channel struct<item {_ITEM}>, item {_ITEM}, entry {_ENTRY}, _bad string"
FEED_COLUMNS = ("title", "summary", "link", "published")
PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def item_columns(e: Column) -> dict[str, Column]:
    """Title, summary, link and date of an RSS item."""
    return {
        "title": strip(_filled(e["title"])),
        "summary": strip_html(e["description"]),
        "link": strip(_filled(e["link"])),
        "published": F.coalesce(blank_to_null(e["pubDate"]), e["dc:date"]),
    }


def entry_columns(e: Column) -> dict[str, Column]:
    """The same of an Atom entry: its first link counts."""
    return {
        "title": strip(_filled(e["title"])),
        "summary": strip_html(F.coalesce(blank_to_null(e["summary"]), e["content"])),
        "link": _filled(F.try_element_at(e["link"], F.lit(1))["_href"]),
        "published": F.coalesce(blank_to_null(e["updated"]), e["published"]),
    }


def parse_feeds(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to one row per entry: source, page_no, part (0 RSS, 1 Atom), pos and its columns."""
    parsed = payloads.select(
        "source", "page_no", F.from_xml("body", _DOCUMENT, PARSING).alias("doc")
    )
    good = parsed.filter("doc._bad IS NULL")

    def rows(part: int, listed: Column, columns: Callable[[Column], dict[str, Column]]) -> DataFrame:
        exploded = good.select("source", "page_no", F.posexplode(listed).alias("pos", "e"))
        named = [c.alias(name) for name, c in columns(F.col("e")).items()]
        return exploded.select("source", "page_no", F.lit(part).alias("part"), "pos", *named)

    items = rows(0, F.coalesce(F.col("doc.channel.item"), F.col("doc.item")), item_columns)
    entries = rows(1, F.col("doc.entry"), entry_columns)
    failures = parsed.filter("doc._bad IS NOT NULL").select(
        *failure("misconfigured", F.concat(F.col("source"), F.lit(": feed is not valid XML")))
    )
    return items.unionByName(entries), failures


def scan_feed_xml(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to one row per entry: source, record_ord, title, summary, link, published.

    RSS items come before Atom entries of one document. A document that isn't valid
    XML fails its source.
    """
    found, failures = parse_feeds(payloads)
    # Entries stand behind the items of the same page: in its upper half of positions.
    half = PAGE_RECORD_BITS - 1
    position = within(F.col("pos"), half, "feed item") + F.col("part") * (1 << half)
    rows = found.select(
        "source", page_record_ord(F.col("page_no"), position).alias("record_ord"), *FEED_COLUMNS
    )
    return rows, failures
