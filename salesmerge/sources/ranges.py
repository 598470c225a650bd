"""Files of any size as byte ranges: what the readers of large JSON and XML files share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .landed import landed_page

#: What a row of a range's reader is: a record, the first, a middle or the last piece of one, a
#: row of the frame around the records, or the number of records of a range.
WHOLE, FIRST, MIDDLE, LAST, FRAME, TOTAL = range(6)


def ranges(spark: SparkSession, path: str, separator: str, *more: str) -> DataFrame:
    """(file, block, `more` metadata, value): texts between separators; a range's rows stay in order.

    The bytes of a range end with a separator, but the last of a file may not.
    """
    texts = spark.read.option("lineSep", separator).text(path)
    return texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        *[F.col(f"_metadata.{name}").alias(name) for name in more],
        F.col("value").cast("binary").alias("value"),
    )


def joined(values: pa.Array, first: bool, separator: bytes) -> np.ndarray:
    """Bytes of consecutive texts and the separators between them; one in front unless `first`."""
    whole = separator.join(values.to_pylist())
    return np.frombuffer(whole if first else separator + whole, np.uint8)


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, bool]]:
    """(key, values, first) for runs of rows of one range; the key is all columns but the last."""
    last = None
    for batch in batches:
        keys = list(zip(*(column.to_pylist() for column in batch.columns[:-1]), strict=True))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            yield keys[lo], batch.columns[-1].slice(lo, hi - lo), keys[lo] != last
            last, lo = keys[lo], hi


def page_labels(file: Column, source: str | None, page_no: Column | None) -> dict[str, Column]:
    """Source and page number: as given, else out of the file's place."""
    named = landed_page(file)
    return {
        "source": F.lit(source) if source is not None else named["source"],
        "page_no": (page_no if page_no is not None else named["page_no"]).cast("bigint"),
    }


def plain_path(file: Column) -> Column:
    """A local path in one form, whichever reader names it."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def bases(totals: DataFrame, *order: str) -> DataFrame:
    """`totals` with `base`: the source's places before each range's, by page, `order` and range.

    `totals` has (file, block, source, page_no, `order`, n), a few rows per range. An empty range
    counts as one place, for a file that is one record.
    """
    window = W.partitionBy("source").orderBy("page_no", *order, "file", "block")
    before = F.sum(F.col("n") + 1).over(window.rowsBetween(W.unboundedPreceding, -1))
    return totals.select(
        "file", "block", "source", "page_no", *order, F.coalesce(before, F.lit(0)).alias("base")
    )


def put_together(pieces: DataFrame) -> DataFrame:
    """Records that cross ranges: (file, block, at, place, text), where their first piece stands.

    `pieces` are the rows of kind FIRST, MIDDLE and LAST, in order of (block, at): a few per range.
    """
    order = W.partitionBy("file").orderBy("block", "at", "kind")
    numbered = pieces.withColumn("number", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "kind", "place", "text")))
    grouped = numbered.groupBy("file", "number").agg(parts.alias("parts"))
    # Middle pieces behind the last one lie outside of any record.
    end = F.array_position(F.transform("parts", lambda p: p["kind"]), LAST).cast("int")
    closed = grouped.withColumn("parts", F.slice("parts", 1, F.greatest(end, F.lit(1))))
    head = F.col("parts")[0]
    whole = closed.filter((head["kind"] == FIRST) & (F.element_at("parts", -1)["kind"] == LAST))
    text = F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "")
    return whole.select(
        "file", head["block"].alias("block"), head["at"].alias("at"), head["place"].alias("place"),
        text.cast("binary").alias("text"),
    )
