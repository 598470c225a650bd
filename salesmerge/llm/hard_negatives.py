"""Hard negatives for anchors, mined by exact integer scores.

Vectors are read as integers, and their inner products come from a residue number system: both
matrices are reduced modulo several small primes, each pair of residue matrices is multiplied in
float32 (every partial sum stays below 2^24, so the product is exact), and Chinese remaindering
joins the residues to the signed score. Primes are added until their product exceeds twice the
largest score that the vectors' lengths allow.

The anchors, a stated set of queries, are met with all rows panel by panel. A panel has a bounded
size and is broadcast; every task reads its rows once, holds the best few of each anchor, and
passes just those on. A first pass finds each anchor's positives, a second the negatives whose
score lies in the window of each positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged

#: Anchors of a panel, about: bounds what is broadcast and what a task holds.
PANEL = 16_384
#: Rows and anchors of one matrix product.
ROWS, ANCHORS = 4_096, 256
#: Components of one product; longer vectors are summed in parts.
SEGMENT = 256
_EXACT = 1 << 24
_NONE = np.iinfo(np.int64).min
#: Scores below this share one number with a row's place in its block.
_NARROW = 1 << 49


def primes(dimension: int, largest: int) -> list[int]:
    """Odd primes, largest first, whose product exceeds 2 * `largest` + 1.

    Products of `dimension` residues of each stay below 2^24 in float32.
    """
    half = int((_EXACT // max(1, min(dimension, SEGMENT))) ** 0.5)
    found, product, at = [], 1, 2 * half + 1
    while product <= 2 * largest + 1 or len(found) < 2:
        if at < 3:
            raise ValueError("scores don't fit in 63 bits")
        if all(at % d for d in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
            product *= at
        at -= 2
    if product >= 1 << 63:
        raise ValueError("scores don't fit in 63 bits")
    return found


@dataclass
class Residues:
    """A matrix of integers modulo each of several primes, in float32 around 0."""

    moduli: list[int]
    parts: list[np.ndarray]

    @classmethod
    def of(cls, matrix: np.ndarray, moduli: list[int]) -> Residues:
        parts = []
        for p in moduli:
            low = matrix % p
            parts.append((low - p * (low > p // 2)).astype(np.float32))
        return cls(moduli, parts)

    def rows(self, lo: int, hi: int) -> Residues:
        return Residues(self.moduli, [part[lo:hi] for part in self.parts])

    def scores(self, other: Residues) -> np.ndarray:
        """Exact signed inner products of all rows with all rows of `other`."""
        value, product = None, 1
        for p, a, b in zip(self.moduli, self.parts, other.parts, strict=True):
            total = None
            for lo in range(0, max(1, a.shape[1]), SEGMENT):
                part = (a[:, lo : lo + SEGMENT] @ b[:, lo : lo + SEGMENT].T).astype(np.int64)
                total = part if total is None else total + part
            if value is None:
                value = total % p
            else:  # the next digit of the mixed-radix number
                value += product * ((total - value) % p * pow(product, -1, p) % p)
            product *= p
        value[value > product // 2] -= product
        return value


class _Best:
    """The best `k` rows for each line: highest score first, then least id, then least row."""

    def __init__(self, lines: int, k: int) -> None:
        self.k = k
        self.score = np.full((lines, k), _NONE)
        self.id = np.zeros((lines, k), np.int64)
        self.row = np.zeros((lines, k), np.int64)

    def add(self, lines: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer `scores` [lines, rows] where `ok`; `ids` ascend, and `rows` within an id."""
        ok &= scores >= self.score[lines, -1][:, None]
        live = np.flatnonzero(ok.any(1))
        if not len(live):
            return
        lines, scores, ok = lines[live], scores[live], ok[live]
        n = scores.shape[1]
        if np.abs(scores).max(initial=0) < _NARROW:
            places = np.arange(n - 1, -1, -1)
            order = np.where(ok, scores * n + places, _NONE)
            take = np.argpartition(order, max(0, n - self.k), axis=1)[:, -self.k :]
        else:
            take = np.argsort(np.where(ok, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, : self.k]
        new = np.where(np.take_along_axis(ok, take, 1), np.take_along_axis(scores, take, 1), _NONE)
        score = np.concatenate([self.score[lines], new], 1)
        id_ = np.concatenate([self.id[lines], ids[take]], 1)
        row = np.concatenate([self.row[lines], rows[take]], 1)
        best = np.lexsort((row, id_, -score.clip(_NONE + 1)), axis=1)[:, : self.k]
        self.score[lines] = np.take_along_axis(score, best, 1)
        self.id[lines] = np.take_along_axis(id_, best, 1)
        self.row[lines] = np.take_along_axis(row, best, 1)


@dataclass
class _Panel:
    """Anchors with their residues; `positives` are (line, score) pairs of the second pass."""

    row: np.ndarray
    label: np.ndarray
    residues: Residues
    line: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors as a matrix of whole numbers; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dimension).all():
        return flat.reshape(len(lengths), dimension)
    out = np.zeros((len(lengths), dimension), np.int64)
    out[np.arange(dimension) < lengths[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], moduli: list[int], dimension: int):
    """(row, id, label, residues) of at most ROWS rows each, by ascending id and row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            row, id_, label = (part.column(k).to_numpy() for k in range(3))
            order = np.lexsort((row, id_))
            matrix = _matrix(part.column(3), dimension)[order]
            yield row[order], id_[order], label[order], Residues.of(matrix, moduli)


def _positives(rows: DataFrame, panel: _Panel, dimension: int, k: int) -> DataFrame:
    """(line, score, id, row): each task's best rows of the anchor's label, itself left out."""
    shared = rows.sparkSession.sparkContext.broadcast(panel)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = _Best(len(own.row), k)
        for row, id_, label, residues in _blocks(batches, own.residues.moduli, dimension):
            for lo in range(0, len(own.row), ANCHORS):
                lines = np.arange(lo, min(lo + ANCHORS, len(own.row)))
                ok = own.label[lines][:, None] == label
                ok &= own.row[lines][:, None] != row
                best.add(lines, own.residues.rows(lo, lo + ANCHORS).scores(residues), ok, id_, row)
        yield _found(best, np.arange(len(own.row)))

    return rows.mapInArrow(find, "line bigint, score bigint, id bigint, row bigint")


def _negatives(rows: DataFrame, panel: _Panel, dimension: int, k: int) -> DataFrame:
    """(line, score, id, row): each task's best rows of another label in the window of a positive."""
    shared = rows.sparkSession.sparkContext.broadcast(panel)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = _Best(len(own.line), k)
        bounds = np.searchsorted(own.line, np.arange(0, len(own.row) + ANCHORS, ANCHORS))
        for row, id_, label, residues in _blocks(batches, own.residues.moduli, dimension):
            for block, lo in enumerate(range(0, len(own.row), ANCHORS)):
                scores = own.residues.rows(lo, lo + ANCHORS).scores(residues)
                other = own.label[lo : lo + ANCHORS][:, None] != label
                at = np.arange(bounds[block], bounds[block + 1])
                # The positives of an anchor take turns, so a block is no larger than its scores.
                turn = at - np.searchsorted(own.line, own.line[at])
                for step in range(int(turn.max(initial=-1)) + 1):
                    lines = at[turn == step]
                    anchor = own.line[lines] - lo
                    mine = scores[anchor]
                    ok = other[anchor] & (mine >= own.low[lines][:, None])
                    ok &= mine <= own.high[lines][:, None]
                    best.add(lines, mine, ok, id_, row)
        yield _found(best, np.arange(len(own.line)))

    return rows.mapInArrow(find, "line bigint, score bigint, id bigint, row bigint")


def _found(best: _Best, lines: np.ndarray) -> pa.RecordBatch:
    line, place = np.nonzero(best.score != _NONE)
    columns = [lines[line], best.score[line, place], best.id[line, place], best.row[line, place]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["line", "score", "id", "row"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best `k` of each line over all tasks, with their `rank` from 1."""
    order = W.partitionBy("line").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usable(rows: DataFrame, anchor: Column, label: Column, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(row, id, label, vector of whole numbers, anchor) of the rows that take part, staged."""
    vector = F.col(vector_column)
    # A condition on a null component is null, so such a vector doesn't pass either.
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return staged(
        rows.where(F.col(id_column).isNotNull() & label.isNotNull() & vector.isNotNull() & whole).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).cast("bigint").alias("id"),
            label.cast("bigint").alias("label"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
            F.coalesce(anchor, F.lit(False)).alias("anchor"),
        ),
        "whole-vectors",
    )


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    label: Column,
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    panel: int = PANEL,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    A component x counts as floor(`scale` * x); scores are inner products of these. The positives
    of an anchor are its best `positives` other rows of equal `label`; for each, the best `negatives`
    rows of another label whose score is at least `low` and at most `high` hundredths of the
    positive's. Equal scores: the smaller id first. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Rows that
    repeat an id are rows of their own, so a repeated anchor has its results twice. Shorter
    vectors are filled up with zeros. An empty table, or one without anchors, gives no rows. Other
    columns are not read. Scores that need more than 62 bits are an error.
    """
    spark = rows.sparkSession
    usable = _usable(rows, anchor, label, id_column, vector_column, scale)
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    # By Cauchy and Schwarz no score exceeds the largest square of a length.
    largest, dimension, anchors = usable.agg(
        F.max(square), F.max(F.size("vector")), F.count_if("anchor")
    ).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not anchors or not dimension:
        return spark.createDataFrame([], result)
    if largest >= 2.0**61:
        raise ValueError("scores don't fit in 63 bits")
    moduli = primes(dimension, int(largest * (1 + 1e-9)) + 1)
    panels = -(-anchors // panel)
    narrow = usable.select("row", "id", "label", "vector")
    parts = []
    for number in range(panels):
        own = usable.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(panels)) == number)
        # About `panel` rows.
        held = own.select("row", "id", "label", "vector").orderBy("row").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        column = held["vector"].combine_chunks()
        matrix = _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dimension)
        anchor_id = held["id"].to_numpy()
        shown = _Panel(held["row"].to_numpy(), held["label"].to_numpy(), Residues.of(matrix, moduli))
        near = staged(_first(_positives(narrow, shown, dimension, positives), positives), "positives")
        pairs = near.orderBy("line", "rank").toArrow()  # `positives` rows an anchor at most
        if not pairs.num_rows:
            continue
        shown.line, score = pairs["line"].to_numpy(), pairs["score"].to_numpy()
        shown.low, shown.high = -((-low * score) // 100), (high * score) // 100
        listed = pa.table(
            {
                "line": pa.array(np.arange(len(score))),
                "anchor_id": pa.array(anchor_id[shown.line]),
                "positive_id": pairs["id"],
                "positive_score": pairs["score"],
            }
        )
        hard = _first(_negatives(narrow, shown, dimension, negatives), negatives)
        named = hard.join(F.broadcast(spark.createDataFrame(listed)), "line")
        parts.append(
            staged(
                named.select(
                    "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score"),
                ),
                "hard-negatives",
            )
        )
    if not parts:
        return spark.createDataFrame([], result)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
