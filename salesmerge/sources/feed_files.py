"""Large RSS and Atom files, read by many tasks.

A file is cut at `>` bytes into byte ranges. Items and entries are told by their tags alone, and
one that crosses ranges is put together from its pieces. A document is well-formed if every item is
and the frame around them is, which is all that has to be read as one text. Where tags mislead
(in comments or character data), the file is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .feeds import (
    ENTRY_FIELDS,
    FEED_COLUMNS,
    ITEM_FIELDS,
    PARSING,
    entry_columns,
    item_columns,
    parse_feeds,
)
from .ranges import (
    FIRST,
    FRAME,
    LAST,
    MIDDLE,
    TOTAL,
    WHOLE,
    bases,
    by_range,
    joined,
    page_labels,
    plain_path,
    put_together,
    ranges,
)

_TAG = re.compile(rb"<(/?)(?:item|entry)(?=[\s/>])[^>]*>")
_PIECES = "file string, block bigint, at bigint, place bigint, kind int, text binary"
_NAMES = ["file", "block", "at", "place", "kind", "text"]
_TYPES = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.binary()]


class _Range:
    """State of one range: its rows so far, and the bytes since the last tag."""

    def __init__(self, key: tuple) -> None:
        self.file, self.block, length, size = key
        self.last = self.block + length >= size
        self.rows: list[tuple] = []
        self.at = self.records = self.tags = 0
        # Whether it begins inside an item isn't known before the first tag.
        self.inside: bool | None = None
        self.held: list[bytes] = []
        self.pending = b""

    def add(self, kind: int, text: bytes | None, place: int) -> None:
        self.rows.append((self.file, self.block, self.at, place, kind, text))
        self.at += 1

    def read(self, data: bytes) -> None:
        """Take more bytes; a tag that isn't closed yet waits for its `>`."""
        data = self.pending + data
        cut = data.rfind(b"<")
        cut = len(data) if cut < 0 or b">" in data[cut:] else cut
        self.pending = data[cut:]
        self.take(data[:cut])

    def take(self, data: bytes) -> None:
        begin = 0
        for tag in _TAG.finditer(data):
            alone = tag[0].endswith(b"/>")
            self.tags += not tag[1]
            if tag[1]:
                self.held.append(data[begin : tag.end()])
                # Without an opening tag in the range, an item goes on from the one before.
                self.flush(LAST if self.inside is None else WHOLE if self.inside else FRAME)
                self.inside, begin = False, tag.end()
            elif not self.inside:
                self.held.append(data[begin : tag.start()])
                self.flush(MIDDLE if self.inside is None else FRAME)
                self.inside, begin = not alone, tag.start()
                if alone:
                    self.held.append(tag[0])
                    self.flush(WHOLE)
                    begin = tag.end()
        self.held.append(data[begin:])

    def flush(self, kind: int) -> None:
        text = b"".join(self.held)
        self.held = []
        if text:
            self.add(kind, text, self.records)
            self.records += kind in (WHOLE, FIRST)

    def finish(self) -> None:
        # Only the end of a file may lack its `>`.
        self.take(self.pending + (b">" if self.pending or not self.last else b""))
        self.flush(MIDDLE if self.inside is None else FIRST if self.inside else FRAME)
        # There are no more items than opening tags, wherever these stand.
        self.add(TOTAL, None, self.tags)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
        arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for key, values, first in by_range(batches):
        if first:
            if own is not None:
                own.finish()
                yield own.batch()
            own = _Range(key)
        own.read(joined(values, first, b">").tobytes())
        yield own.batch()
    if own is not None:
        own.finish()
        yield own.batch()


def _frames(pieces: DataFrame, across: DataFrame) -> DataFrame:
    """(file, bad): the text around the items, and what is wrong with it; small in a feed."""
    order = W.partitionBy("file").orderBy("block", "at")
    numbered = across.withColumn("number", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    before = W.partitionBy("file", "number").orderBy("block", "at").rowsBetween(W.unboundedPreceding, -1)
    closed = F.max((F.col("kind") == LAST).cast("int")).over(before)
    # Pieces before the first item, and between one that has ended and the next.
    outside = numbered.withColumn("closed", closed).filter("number = 0 OR closed = 1")
    frame = pieces.filter(F.col("kind") == FRAME).unionByName(outside.select(*pieces.columns))
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("block", "at", "text"))), lambda p: p["text"].cast("string")
    )
    whole = frame.groupBy("file").agg(F.array_join(texts, "").alias("frame"))
    return whole.select("file", F.from_xml("frame", "_any string, _bad string", PARSING)["_bad"].alias("bad"))


def scan_feed_files(
    spark: SparkSession, path: str, source: str | None = None, page_no: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Feed files at `path` to one row per entry: source, record_ord, title, summary, link, published.

    As `scan_feed_xml`, but no file has to fit in a row, and `record_ord` counts through all pages
    of a source without a limit, items before entries of a page. Source and page number come from the
    file's place, `<source>/<page number>.<anything>`, unless they are given.
    """
    label = page_labels(F.col("file"), source, page_no)
    texts = ranges(spark, path, ">", "file_block_length", "file_size")
    pieces = stage(texts.mapInArrow(_cut, _PIECES), "feeds")
    across = pieces.filter(F.col("kind").isin(FIRST, MIDDLE, LAST))
    crossing = stage(put_together(across), "crossing")
    records = pieces.filter(F.col("kind") == WHOLE).select(*crossing.columns).unionByName(crossing)
    text = F.col("text").cast("string")
    is_item = text.rlike(r"^<item[\s/>]")
    parsed = stage(
        records.select(
            "file", "block", "place", F.when(is_item, 0).otherwise(1).alias("part"),
            F.when(is_item, F.from_xml(text, f"{ITEM_FIELDS}, _bad string", PARSING)).alias("item"),
            F.when(~is_item, F.from_xml(text, f"{ENTRY_FIELDS}, _bad string", PARSING)).alias("entry"),
        ),
        "items",
    )
    frames = stage(_frames(pieces, across), "frames")
    begun = across.filter(F.col("kind") == FIRST).select("file", "block", "at")
    # What the tags alone don't tell, or what isn't XML.
    doubtful = stage(
        parsed.filter("item._bad IS NOT NULL OR entry._bad IS NOT NULL").select("file")
        .union(frames.filter("bad IS NOT NULL").select("file"))
        .union(pieces.select("file").distinct().join(frames, "file", "left_anti").select("file"))
        .union(begun.join(crossing, ["file", "block", "at"], "left_anti").select("file"))
        .distinct(),
        "doubtful",
    )
    totals = pieces.filter(F.col("kind") == TOTAL).select("file", "block", F.col("place").alias("n"))
    parts = totals.withColumns(label).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    starts = stage(bases(parts, "part"), "starts")
    kept = parsed.join(doubtful, "file", "left_anti").join(starts, ["file", "block", "part"])
    order = (F.col("base") + F.col("place")).alias("record_ord")
    items, entries = (
        kept.filter(F.col("part") == part).select(
            "source", order, *[c.alias(name) for name, c in columns(F.col(field)).items()]
        )
        for part, field, columns in ((0, "item", item_columns), (1, "entry", entry_columns))
    )
    bodies = spark.read.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("body")
    )
    bodies = bodies.join(doubtful.select(plain_path(F.col("file")).alias("file")), "file", "left_semi")
    whole, failures = parse_feeds(bodies.withColumns(label).select("source", "page_no", "body"))
    pages = starts.groupBy("source", "page_no", "part").agg(F.min("base").alias("base"))
    whole = whole.join(pages, ["source", "page_no", "part"]).select(
        "source", (F.col("base") + F.col("pos")).alias("record_ord"), *FEED_COLUMNS
    )
    good = items.unionByName(entries)
    if doubtful.isEmpty():
        none = spark.createDataFrame([], "source STRING, page_no BIGINT, status STRING, message STRING")
        return good, none
    return good.unionByName(whole), failures
