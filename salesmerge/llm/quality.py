"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text is a bag of hashed n-grams: runs of four bytes, words, and pairs of words (a word that is repeated
at once is the same n-gram whatever the word). All texts give the raw model; those labelled
good give the target model. The importance weight of a text is the ratio of the probabilities that
the two models give its bag. Adding Gumbel noise to the logarithm of the weights and taking the k
largest draws k texts without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged
from salesmerge.llm.words import SPACES, Slice, mix, slices, words

BUCKETS = 1 << 16
RUN = 4
#: Up to so many labels are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
_REPEAT = np.uint64(0x52E9EA7)


def _grams(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of a slice, sorted by row within each kind."""
    data, n = piece.data.astype(np.uint64), len(piece.data)
    rows, codes = [], []
    if n >= RUN:
        code = data[: n - RUN + 1].copy()
        for k in range(1, RUN):
            code |= data[k : n - RUN + 1 + k] << np.uint64(8 * k)
        row = np.repeat(np.arange(len(piece.offsets) - 1), np.diff(piece.offsets))
        inside = row[: n - RUN + 1] == row[RUN - 1 :]
        rows.append(row[: n - RUN + 1][inside])
        codes.append(mix(code[inside] + np.uint64(1)))
    found = words(piece, SPACES)
    row = np.repeat(np.arange(len(found.rows) - 1), np.diff(found.rows))
    rows.append(row)
    codes.append(found.hashes)
    pair = np.flatnonzero(row[1:] == row[:-1])
    left, right = found.hashes[pair], found.hashes[pair + 1]
    with np.errstate(over="ignore"):
        code = mix(left * np.uint64(3) + right)
    rows.append(row[pair])
    codes.append(np.where(left == right, _REPEAT, code))
    return np.concatenate(rows), (np.concatenate(codes) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Ratio:
    """Log ratio of the target to the raw model by bucket, and the line to a probability."""

    logs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def count(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts of all buckets over the rows (text, target)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for piece in slices(batch.column(0)):
                row, bucket = _grams(piece)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                own = good[piece.first : piece.last][row]
                total[1] += np.bincount(bucket[own], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])],
            names=["bucket", "raw", "target"],
        )

    counted = rows.select("text", "target").mapInArrow(add, "bucket bigint, raw bigint, target bigint")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[0][table["bucket"].to_numpy()] = table["raw"].to_numpy()
    out[1][table["bucket"].to_numpy()] = table["target"].to_numpy()
    return out[0], out[1]


def weigh(rows: DataFrame, ratio: Ratio, id_column: str, text_column: str) -> DataFrame:
    """(id, log_weight, grams): summed log ratio and number of n-grams of each whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.logs
        for batch in batches:
            for piece in slices(batch.column(1)):
                size = piece.last - piece.first
                row, bucket = _grams(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, size),
                        pa.array(np.bincount(row, logs[bucket], size).astype(np.float64)),
                        pa.array(np.bincount(row, minlength=size), pa.int64()),
                    ],
                    names=["id", "log_weight", "grams"],
                )

    narrow = rows.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(score, f"id {kind}, log_weight double, grams bigint")


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 20_000) -> Ratio:
    """Models from documents (id, text) and labels (id, quality) where `learn` holds for the id.

    Every text counts for the raw model, every learning text of quality 1 for the target model. The
    probability is calibrated on `sample` learning labels, those of least id hash. Rows
    with null ids have no label; of an id with both labels neither counts.
    """
    told = staged(
        labels.where(F.col("id").isNotNull() & F.col("quality").isNotNull() & learn)
        .groupBy("id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
        .where("low = quality")
        .select("id", "quality"),
        "quality-labels",
    )
    small = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    joined = documents.join(small, "id", "left")
    raw, target = count(joined.select("text", (F.col("quality") == 1).alias("target")))
    # Dirichlet smoothing of the target towards the raw model keeps unseen n-grams neutral.
    share = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    prior = 1.0
    logs = np.log((target + prior * share * BUCKETS) / (target.sum() + prior * BUCKETS)) - np.log(share)
    ratio = Ratio(logs if target.sum() else np.zeros(BUCKETS))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    picked = documents.join(F.broadcast(staged(chosen, "quality-sample")), "id")
    scored = (
        weigh(picked.select("id", "text"), ratio, "id", "text")
        .join(F.broadcast(chosen), "id")
        .select("quality", (F.col("log_weight") / F.greatest("grams", F.lit(1))).alias("mean"))
        .toArrow()
    )
    x, y = scored["mean"].to_numpy(), scored["quality"].to_numpy().astype(float)
    if len(y) and y.min() < y.max():
        ratio.slope, ratio.shift = _line(x, y)
    return ratio


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, lightly regularized."""
    spread = max(float(x.std()), 1e-9)
    z = np.stack([x / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        w = w - np.linalg.solve(curve, z.T @ (p - y) + 1e-3 * w)
    return float(w[0] / spread), float(w[1])


def gumbel_top(weights: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """The rows (id, log_weight) with `selected`: the k of the largest log weight plus Gumbel noise.

    The noise depends on id and seed alone; ties go to the smaller id. The bound is found by counting:
    16 bits of the sortable key a pass, so no task and no driver ever holds the rows.
    """
    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = F.col("log_weight") - F.log(-F.log(uniform))
    keyed = staged(weights.withColumn("noisy", noisy), "gumbel")
    # Fixed point, high enough for any weight of a text of 10^11 n-grams.
    code = F.round(F.greatest(F.lit(-4e12), F.least(F.lit(4e12), F.col("noisy"))) * 1e6).cast("bigint")
    keyed = keyed.withColumn("code", code + F.lit(1 << 62))
    left, low, high = k, 0, (1 << 63) - 1
    for shift in (47, 31, 15, 0):
        width = 1 << shift
        counted = (
            keyed.where(F.col("code").between(low, high))
            .groupBy(F.shiftright("code", shift).alias("part"))
            .count()
            .orderBy(F.desc("part"))
            .collect()
        )
        for row in counted:
            low, high = row["part"] * width, row["part"] * width + width - 1
            if row["count"] >= left:
                break
            left -= row["count"]
        else:
            return keyed.withColumn("selected", F.lit(True))
        if row["count"] == left:
            return keyed.withColumn("selected", F.col("code") >= low)
    tied = [r["id"] for r in keyed.where(F.col("code") == low).select("id").orderBy("id").limit(left).collect()]
    chosen = (F.col("code") > low) | ((F.col("code") == low) & F.coalesce(F.col("id") <= tied[-1], F.lit(True)))
    return keyed.withColumn("selected", chosen)


def classify(
    documents: DataFrame,
    ratio: Ratio,
    share: float = 0.5,
    seed: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`id_column`, log_weight, score (0 to 1), predicted (1: good), selected (in the sample).

    `share` of the rows is sampled, rounded down. A null or empty text has weight 0 and the score
    of an average text. Ids may be null or repeat; a row with an id is sampled as its copies are.
    """
    weighed = staged(weigh(documents, ratio, id_column, text_column), "weights")
    k = int(weighed.count() * share)
    mean = F.col("log_weight") / F.greatest("grams", F.lit(1))
    score = 1 / (1 + F.exp(-(mean * ratio.slope + ratio.shift)))
    sampled = gumbel_top(weighed, k, seed) if k else weighed.withColumn("selected", F.lit(False))
    return sampled.select(
        F.col("id").alias(id_column), "log_weight", score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), "selected",
    )
