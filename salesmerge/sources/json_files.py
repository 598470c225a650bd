"""Large JSON files, read by many tasks.

A file is cut at `}` bytes into byte ranges, as text files are cut at line ends. Whether a range begins
inside a string, and how deep, depends on all bytes before it, so the first pass maps each of
the two possible entries of a range to its exit, and the maps of a file are composed in order. With
the entries known, the second pass finds the members of the array that `records_path` leads to;
a member that crosses ranges is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import variant_kind
from ..session import stage
from .json_records import scan_json_records
from .landed import failure
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

_QUOTE, _BACKSLASH = 0x22, 0x5C
_OPEN, _CLOSE = (0x7B, 0x5B), (0x7D, 0x5D)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: A key and its bracket stand within so many bytes, else the file is read as one text.
_KEY_BYTES = 4096
def _brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and signs (+1, -1) of brackets outside strings, and whether the end is in a string."""
    quotes = np.flatnonzero(data == _QUOTE)
    slashes = data == _BACKSLASH
    if slashes.any() and len(quotes):
        plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero(np.isin(data, (*_OPEN, *_CLOSE)))
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, np.where(np.isin(data[at], _OPEN), 1, -1), bool((len(quotes) + inside) % 2)


_MAP_SCHEMA = "file string, block bigint, size bigint, bytes bigint, flips int, outer bigint, inner bigint"


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its bytes, whether it flips the string state, its depth by either entry."""

    def row(key: tuple, held: list) -> pa.RecordBatch:
        size, flips, outer, inner = held
        columns = [[key[0]], [key[1]], [key[2]], [size], [int(flips)], [outer], [inner]]
        names = ["file", "block", "size", "bytes", "flips", "outer", "inner"]
        types = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    key, held = None, []
    for own, values, first in by_range(batches):
        if first:
            if key is not None:
                yield row(key, held)
            key, held = own, [0, False, 0, 0]
        data = joined(values, first, b"}")
        depth = []
        for inside in (held[1], not held[1]):
            _, signs, end = _brackets(data, inside)
            depth.append((int(signs.sum()), end))
        held = [held[0] + len(data), depth[0][1], held[2] + depth[0][0], held[3] + depth[1][0]]
    if key is not None:
        yield row(key, held)


def _entries(maps: DataFrame) -> DataFrame:
    """Each range with its true start, string state and depth at entry: the composed maps of a file.

    `closed` says whether a `}` follows the range; only a file's last one may lack it. Also `ends`,
    whether the whole file is balanced. A file has one row per range.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("inside"), F.lit(0).cast("bigint").alias("depth"),
        F.array().cast("array<struct<block:bigint,at:bigint,inside:int,depth:bigint,closed:boolean>>").alias("done"),
    )

    def step(s: Column, r: Column) -> Column:
        depth = s["depth"] + F.when(s["inside"] == 0, r["outer"]).otherwise(r["inner"])
        inside = s["inside"].bitwiseXOR(r["flips"])
        closed = s["at"] + r["bytes"] + 1 <= r["size"]
        entry = F.struct(
            r["block"].alias("block"), s["at"].alias("at"), s["inside"].alias("inside"),
            s["depth"].alias("depth"), closed.alias("closed"),
        )
        return F.struct(
            (s["at"] + r["bytes"] + 1).alias("at"),
            inside.alias("inside"),
            F.when(closed & (inside == 0), depth - 1).otherwise(depth).alias("depth"),
            F.concat(s["done"], F.array(entry)).alias("done"),
        )

    ordered = F.sort_array(F.collect_list(F.struct("block", "bytes", "flips", "outer", "inner", "size")))
    folded = maps.groupBy("file").agg(F.aggregate(ordered, start, step).alias("end"))
    ends = (F.col("end.depth") == 0) & (F.col("end.inside") == 0)
    return folded.select("file", F.inline("end.done"), ends.alias("ends"))


# `place` counts a range's records; for a bracket above them it is the depth after it, `turn` is
# 1 or -1 for an object's, 2 or -2 for an array's, and `key` the name before it.
_PIECES = "file string, block bigint, at bigint, place bigint, kind int, turn int, key string, text binary"


def _pieces(entered: DataFrame, inside_depth: int) -> DataFrame:
    """Rows of the kinds above; records are objects just inside depth `inside_depth`."""

    class Range:
        """State of one range: where it is, and the bytes of a record that is still open."""

        def __init__(self, key: tuple) -> None:
            self.file, self.block, self.at, inside, self.depth, self.closed = key
            self.inside = bool(inside)
            self.records, self.open, self.object = 0, None, False
            # A value that was open at the entry: its end is in here, or it goes on.
            self.entered = self.depth > inside_depth
            if self.entered:
                self.open, self.object, self.open_at = [], True, self.at
            self.rows: list[tuple] = []

        def add(
            self, at: int, kind: int, place: int, turn: int = 0, key: str | None = None, text: bytes | None = None
        ) -> None:
            self.rows.append((self.file, self.block, at, place, kind, turn, key, text))

        def read(self, data: np.ndarray) -> None:
            places, signs, end = _brackets(data, self.inside)
            depths = self.depth + np.cumsum(signs)
            raw = data.tobytes()
            above = np.flatnonzero(
                np.where(signs > 0, depths <= inside_depth, depths < inside_depth)
            )
            for k in above.tolist():
                p = int(places[k])
                found = _KEY.search(raw[max(0, p - _KEY_BYTES) : p]) if signs[k] > 0 else None
                key = json.loads(b'"' + found[1] + b'"') if found else None
                turn = int(signs[k]) * (2 if raw[p : p + 1] in b"[]" else 1)
                self.add(self.at + p, FRAME, int(depths[k]), turn, key)
            edge = np.where(signs > 0, depths == inside_depth + 1, depths == inside_depth)
            begin = 0
            for p, sign in zip(places[edge].tolist(), signs[edge].tolist(), strict=True):
                if sign > 0:
                    self.open, self.object, self.open_at, begin = [], raw[p] == _OPEN[0], self.at + p, p
                elif self.open is not None:
                    self.open.append(raw[begin : p + 1])
                    self.close(LAST if self.entered else WHOLE)
            if self.open is not None:
                self.open.append(raw[begin:])
            self.at += len(data)
            self.inside = end
            self.depth = int(depths[-1]) if len(depths) else self.depth

        def close(self, kind: int) -> None:
            if self.object or kind in (LAST, MIDDLE):
                self.add(self.open_at, kind, self.records, text=b"".join(self.open))
                self.records += kind in (WHOLE, FIRST)
            self.open, self.entered = None, False

        def finish(self) -> None:
            if self.closed:
                self.read(np.frombuffer(b"}", np.uint8))
            if self.open is not None:
                self.close(MIDDLE if self.entered else FIRST)
            self.add(self.at, TOTAL, self.records)

        def batch(self) -> pa.RecordBatch:
            rows, self.rows = self.rows, []
            types = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.string(), pa.binary()]
            names = ["file", "block", "at", "place", "kind", "turn", "key", "text"]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for key, values, first in by_range(batches):
            if first:
                if own is not None:
                    own.finish()
                    yield own.batch()
                own = Range(key)
            own.read(joined(values, first, b"}"))
            yield own.batch()
        if own is not None:
            own.finish()
            yield own.batch()

    return entered.mapInArrow(cut, _PIECES)


def _targets(pieces: DataFrame, path: list[str]) -> DataFrame:
    """(file, from_at, to_at): where the array at `path` stands, for each file that has one."""

    def find(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["at", "place", "turn", "key"]).to_pylist(), key=lambda r: r["at"])
        matched, found, begin = [True], None, None
        for r in rows:
            depth, opens, array = r["place"], r["turn"] > 0, abs(r["turn"]) == 2
            if opens:
                del matched[depth:]
                matched.append(matched[-1] and (depth == 1 or r["key"] == path[depth - 2]))
                if depth == len(path) + 1:
                    begin = r["at"] if matched[-1] and array else None
            elif depth == len(path) and begin is not None:
                found, begin = (begin, r["at"]), None  # of equal keys the last counts
        file = table["file"][0].as_py()
        out = [{"file": file, "from_at": found[0], "to_at": found[1]}] if found else []
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("from_at", pa.int64()), ("to_at", pa.int64())]))

    shallow = pieces.filter(F.col("kind") == FRAME).select("file", "at", "place", "turn", "key")
    return shallow.groupBy("file").applyInArrow(find, "file string, from_at bigint, to_at bigint")


def scan_json_files(
    spark: SparkSession, path: str, records_path: str = "", source: str | None = None, page_no: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """JSON files at `path` to one row per record: (source, page_no, record_ord, record).

    As `scan_json_records`, but no file has to fit in a row, and `record_ord` counts through all
    pages of a source without a limit. `records_path` has object keys only. A file whose path doesn't
    lead to an array is read as one text; an empty file holds nothing. Source and page number come
    from the file's place, `<source>/<page number>.<anything>`, unless they are given.
    """
    steps = [s for s in records_path.split(".") if s]
    if any(s.isdigit() for s in steps):
        raise ValueError("a list index in records_path needs scan_json_records")
    label = page_labels(F.col("file"), source, page_no)
    maps = ranges(spark, path, "}", "file_size").mapInArrow(_maps, _MAP_SCHEMA)
    entries = stage(_entries(stage(maps, "ranges")), "entries")
    entered = ranges(spark, path, "}").join(
        F.broadcast(entries.drop("ends")), ["file", "block"]  # one row per range of a task
    ).select("file", "block", "at", "inside", "depth", "closed", "value")
    pieces = stage(_pieces(entered, len(steps) + 1), "records")
    files = spark.read.format("binaryFile").load(path).select(plain_path(F.col("path")).alias("file"))
    files = files.join(
        entries.select(plain_path(F.col("file")).alias("file"), "ends").distinct(), "file", "left"
    )
    targets = stage(_targets(pieces, steps), "arrays")
    totals = pieces.filter(F.col("kind") == TOTAL).select("file", "block", F.col("place").alias("n"))
    starts = bases(totals.withColumns(label))
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "block", "at", "place", "text")
    across = put_together(pieces.filter(F.col("kind").isin(FIRST, MIDDLE, LAST)))
    inside = whole.unionByName(across).join(targets, "file").filter("at > from_at AND at < to_at")
    records = inside.join(starts, ["file", "block"]).select(
        "source", "page_no", (F.col("base") + F.col("place")).alias("record_ord"), "file",
        F.try_parse_json(F.col("text").cast("string")).alias("record"),
    )
    broken = F.concat("source", F.lit(": payload is not JSON"))
    unread = records.filter("record IS NULL").select("source", "page_no").distinct()
    unbalanced = files.filter("ends = false").withColumns(label).select("source", "page_no")
    failures = unread.union(unbalanced).distinct().select(*failure("error", broken))
    good = records.filter("record IS NOT NULL").drop("file")
    # Files without such an array: an object, a scalar, nothing, or no JSON.
    others = files.filter("coalesce(ends, true)").join(
        targets.select(plain_path(F.col("file")).alias("file")), "file", "left_anti"
    )
    others = stage(others.select("file"), "others")
    if not others.isEmpty():
        texts = spark.read.text(path, wholetext=True)
        bodies = texts.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("body"))
        firsts = starts.groupBy("source", "page_no").agg(F.min("base").alias("base"))
        bodies = others.join(bodies, "file", "left").withColumns(label)
        bodies = bodies.select("source", "page_no", F.coalesce("body", F.lit("")).alias("body"))
        single, failed = scan_json_records(bodies, records_path)
        single = single.filter(variant_kind(F.col("record")) == "object").join(firsts, ["source", "page_no"])
        good = good.unionByName(
            single.select("source", "page_no", (F.col("base") + F.col("pos")).alias("record_ord"), "record")
        )
        failures = failures.unionByName(failed)
    return good, failures
