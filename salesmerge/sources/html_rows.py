"""Rows of HTML pages by selector."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ROW_TEXT_CHARS
from ..schema import RAW_REPORT_SCHEMA, page_record_ord
from ..functions.text import blank_to_null
from .landed import failure
from .selectors import Node, Selector

_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
_NO_TEXT = ("script", "style", "template")


_CELLS, _ROWS = ("td", "th"), ("tbody", "thead", "tfoot")
# Tags whose start ends an open element of its kind, up to the container it stands in.
_ENDS = {
    "td": (_CELLS, ("tr", "table")),
    "th": (_CELLS, ("tr", "table")),
    "tr": ((*_CELLS, "tr"), (*_ROWS, "table")),
    **{tag: ((*_CELLS, "tr", *_ROWS), ("table",)) for tag in _ROWS},
    "li": (("li",), ("ul", "ol")),
    "option": (("option",), ("select",)),
}


class _Element(Node):
    __slots__ = ()

    def descendants(self):
        """All elements below, in page order; iterative, since pages may nest deeply."""
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, _Element):
                yield child
                waiting.append(iter(child.children))

    def strings(self):
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                if child.strip():
                    yield child.strip()
            elif child.tag not in _NO_TEXT:
                waiting.append(iter(child.children))

    def text(self) -> str:
        return " ".join(self.strings())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            ended, stops = _ENDS[tag]
            above = self.open
            while above.parent is not None and above.tag not in stops:
                if above.tag in ended:
                    self.open = above.parent
                above = above.parent
        element = _Element(tag, dict(attrs), self.open)
        if tag not in _VOID:
            self.open = element

    def handle_startendtag(self, tag, attrs):
        _Element(tag, dict(attrs), self.open)

    def handle_endtag(self, tag):
        element = self.open
        while element.parent is not None:
            if element.tag == tag:
                self.open = element.parent
                return
            element = element.parent

    def handle_data(self, data):
        self.open.children.append(data)

    def forget(self):
        """Take the page apart: elements know their parents, and such circles wait long to be freed."""
        for element in [self.root, *self.root.descendants()]:
            element.children.clear()


_SCHEMA = (
    "source STRING, page_no BIGINT, pos INT, cells MAP<STRING, STRING>, row_text STRING, url STRING, "
    "error STRING"
)
_TYPES = {
    "source": pa.string(), "page_no": pa.int64(), "pos": pa.int32(), "cells": pa.map_(pa.string(), pa.string()),
    "row_text": pa.string(), "url": pa.string(), "error": pa.string(),
}
# Rows that are handed on together.
_CHUNK = 1000


def scan_html_rows(
    payloads: DataFrame, row_selector: str, cell_map: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Pages to one row per selected element, and a failure row per page that can't be read.

    Rows have source, page_no, pos, cells, row_text, url. Cell text has its blanks joined and
    trimmed; empty cells are absent. The cell mapped to `source_url` yields its link. Selectors
    know tags (any case), classes, ids, attributes, places among siblings, `:not` and `:is`, all
    four combinators, and lists separated by commas; others are refused. Table parts and list items may lack their end tags. One page is parsed at a
    time, and its rows are handed on in chunks.
    """
    for selector in (row_selector, *cell_map.values()):
        Selector(selector)  # refused here, not on the executors
    has_url = "url" in payloads.columns

    def read(page, source, page_no, body, url, rows_by, cells_by):
        page.feed(body or "")
        page.close()
        rows = (e for e in page.root.descendants() if rows_by.matches(e))
        for pos, row in enumerate(rows):
            cells, missing = {}, dict(cells_by)
            for e in row.descendants():  # all targets in one walk
                for target in [t for t, selector in missing.items() if selector.matches(e)]:
                    del missing[target]
                    if text := e.text():
                        cells[target] = text
                    if target == "source_url" and "href" in e.attrs:
                        cells[target] = e.attrs["href"]
                if not missing:
                    break
            yield source, page_no, pos, [*cells.items()], row.text(), url, None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(_TYPES)
        arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES.values(), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(_TYPES))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows_by = Selector(row_selector)
        cells_by = {target: Selector(selector) for target, selector in cell_map.items()}
        for batch in batches:
            for k in range(len(batch)):  # one page as a Python text
                source, page_no, body, url = (column[k].as_py() for column in batch.columns)
                for selector in (rows_by, *cells_by.values()):
                    selector.page_ends()
                page = _Page()
                try:
                    for row in read(page, source, page_no, body, url, rows_by, cells_by):
                        out.append(row)
                        if len(out) == _CHUNK:
                            yield batch_of(out)
                            out = []
                except Exception as error:  # whatever a page holds, the others are read
                    message = f"{source}: page can't be read ({type(error).__name__})"
                    out.append((source, page_no, None, [], None, url, message))
                page.forget()
        yield batch_of(out)

    pages = payloads.select(
        "source", "page_no", "body", F.col("url") if has_url else F.lit(None).cast("string").alias("url")
    )
    parsed = pages.mapInArrow(parse, _SCHEMA)
    failures = parsed.filter("error IS NOT NULL").select(*failure("misconfigured", F.col("error")))
    return parsed.filter("error IS NULL").drop("error"), failures


def html_reports(rows: DataFrame) -> DataFrame:
    """Rows with an address to raw reports (the rest is unusable)."""
    known = set(RAW_REPORT_SCHEMA.fieldNames()) - {"seq", "source", "raw", "price_num", "sale_date_num"}
    cell = lambda name: blank_to_null(F.col("cells")[name])
    renamed = {"price_text": "price", "sale_date_text": "sale_date"}
    plain = sorted(known - set(renamed) - {"source_url", "latitude", "longitude"})
    raw = F.to_json(F.struct(F.substring("row_text", 1, ROW_TEXT_CHARS).alias("row_text")))
    return rows.filter(cell("address").isNotNull()).select(
        "source",
        page_record_ord(F.col("page_no"), F.col("pos")).alias("record_ord"),
        *[cell(name).alias(name) for name in plain],
        *[cell(name).alias(column) for column, name in renamed.items()],
        *[cell(name).try_cast("double").alias(name) for name in ("latitude", "longitude")],
        F.coalesce(cell("source_url"), F.col("url")).alias("source_url"),
        raw.alias("raw"),
    )
