"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the text times a damped inverse document
frequency, read from hashed frequencies over all texts (a fixed number of buckets, so the
table's size is known). Damping keeps weights between 1 and 1.5: without it the words that
tell two copies apart would outweigh the words of a widely copied text.

Each of `bands * rows` samples picks one shingle of a text; two texts pick the same with the
probability of their weighted Jaccard similarity. Texts that agree in all samples of a band are
candidates, and a link is a candidate pair whose exact weighted similarity reaches the threshold.

Equal texts are one class from the start. In each bucket of a band, texts are verified against
the bucket's best-known text, so a bucket of n texts costs n checks. Where candidates that hang
together are still in different groups, they are dealt into tiles, and each pair of tiles is
compared inside a task: pairs that share a bucket and agree in enough samples are verified until they
are joined. No pair leaves the task but those that join two groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import components, staged
from salesmerge.llm.words import MARKS, Slice, gather, mix, shingles, slices, valid, words

SHINGLE = 5
#: Buckets of the hashed document frequencies.
BUCKETS = 1 << 18
_DAMPING = 0.5
_POOL = 1 << 14
#: Bytes of text read at once; bounds a task's memory beside a single longer text.
SLICE = 1 << 19
#: Texts of one tile; a task compares two tiles at most.
TILE = 500
#: Up to so many rows of 40 bytes a join side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def bags(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each text, in this order.

    Words are runs of letters and digits, ASCII case folded. Fewer than five are one shingle.
    """
    found = words(piece, MARKS, fold=True)
    sizes = np.diff(found.rows)
    hashes = shingles(found.hashes, SHINGLE)
    inside = valid(found.rows, len(found.hashes), SHINGLE)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)][inside]
    hashes = hashes[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = [
            hash(tuple(found.hashes[found.rows[r] : found.rows[r + 1]].tolist())) & (2**63 - 1)
            for r in short.tolist()
        ]
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, mix(np.array(own, np.uint64))])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(documents: DataFrame, text_column: str) -> np.ndarray:
    """Weight factor of each bucket, from the number of texts with a shingle in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for piece in slices(batch.column(0), SLICE):
                row, hashes, _ = bags(piece)
                total += np.bincount(_bucket(hashes), minlength=BUCKETS)
                texts += int((np.diff(row, prepend=-1) != 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))],
            names=["bucket", "n"],
        )

    counted = documents.select(text_column).mapInArrow(count, "bucket bigint, n bigint")
    table = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    texts = max(1, int(n[bucket < 0].sum()))
    total = np.zeros(BUCKETS, np.int64)
    total[bucket[bucket >= 0]] = n[bucket >= 0]
    rarity = np.log((texts + 1) / (np.minimum(total, texts) + 1)) / np.log(texts + 1)
    return (1 + _DAMPING * rarity).astype(np.float32)


class _Sampler:
    """Consistent weighted samples; the random numbers of a shingle come from fixed pools."""

    def __init__(self, samples: int) -> None:
        pool = np.random.default_rng(20240229)
        self.samples = samples
        self.r = pool.gamma(2.0, 1.0, _POOL).astype(np.float32)
        self.log_c = np.log(pool.gamma(2.0, 1.0, _POOL)).astype(np.float32)
        self.beta = pool.random(_POOL).astype(np.float32)

    def of(self, row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """An int32 array of n texts by samples; 0 throughout for texts without shingles."""
        out = np.zeros((n, self.samples), np.int32)
        if not len(row):
            return out
        first = np.flatnonzero(np.diff(row, prepend=-1))
        own, size = row[first], np.diff(np.append(first, len(row)))
        logs = np.log(weight).astype(np.float32)
        step = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        at = hashes.copy()
        with np.errstate(over="ignore"):
            for k in range(self.samples):
                at += step
                pool = (at >> np.uint64(50)).astype(np.int64)
                r, beta = self.r[pool], self.beta[pool]
                level = np.floor(logs / r + beta)
                value = self.log_c[pool] - r * (level - beta + 1)
                least = np.repeat(np.minimum.reduceat(value, first), size)
                hit = np.flatnonzero(value == least)  # of equal values the least hash
                hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
                picked = mix(hashes[hit] + level[hit].astype(np.int64).astype(np.uint64))
                out[own, k] = (picked >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def _signatures(
    documents: DataFrame, factors, samples: int, id_column: str, text_column: str
) -> DataFrame:
    """(id, class, samples): the samples are null for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, factor = _Sampler(samples), factors.value
        for batch in batches:
            for piece in slices(batch.column(1), SLICE):
                size = piece.last - piece.first
                row, hashes, count = bags(piece)
                signs = sampler.of(row, hashes, count * factor[_bucket(hashes)], size)
                has = np.zeros(size, bool)
                has[row] = True
                bounds = np.arange(size + 1, dtype=np.int32) * samples
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, size),
                        batch.column(2).slice(piece.first, size),
                        pa.ListArray.from_arrays(
                            pa.array(bounds), pa.array(signs.reshape(-1)), mask=pa.array(~has)
                        ),
                    ],
                    names=["id", "class", "samples"],
                )

    narrow = documents.select(id_column, text_column, F.md5(text_column).alias("class"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(sign, f"id {kind}, class string, samples array<int>")


def _similarity(first, second, pair_a: np.ndarray, pair_b: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of text pair_a[i] of one bag set and pair_b[i] of the other."""
    n = len(pair_a)
    parts = []
    for (row, hashes, count), chosen in ((first, pair_a), (second, pair_b)):
        size = int(max(row.max(initial=-1), chosen.max(initial=-1))) + 1
        bounds = np.searchsorted(row, np.arange(size + 1))
        lengths = np.diff(bounds)[chosen]
        at = gather(bounds[chosen], lengths)
        parts.append((np.repeat(np.arange(n), lengths), hashes[at], count[at]))
    row, hashes, weight = (np.concatenate([x[k] for x in parts]) for k in range(3))
    weight = weight * factor[_bucket(hashes)]
    order = np.lexsort((hashes, row))
    row, hashes, weight = row[order], hashes[order], weight[order]
    pair = np.flatnonzero((row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]))
    low = np.bincount(row[pair], np.minimum(weight[pair], weight[pair + 1]), n)
    return low / np.maximum(np.bincount(row, weight, n) - low, 1e-12)


def _similar(pairs: DataFrame, factors, threshold: float) -> DataFrame:
    """Of the rows (x, y, text_x, text_y) the (x, y) of sufficient weighted Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(2), SLICE):
                size = piece.last - piece.first
                for other in slices(batch.column(3).slice(piece.first, size)):
                    at = np.arange(other.last - other.first)
                    value = _similarity(bags(piece), bags(other), other.first + at, at, factors.value)
                    good = pa.array(value >= threshold - 1e-9)
                    own = batch.slice(piece.first + other.first, len(at))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0).filter(good), own.column(1).filter(good)], names=["x", "y"]
                    )

    return pairs.mapInArrow(check, "x string, y string")


def _within(factors, threshold: float, bands: int, least: int):
    """Links between different groups of a tile pair, as few as connect what all would."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"x": [], "y": []}, dtype=object)
        tile = tile.drop_duplicates("class").sort_values("class", ignore_index=True)
        names, label = tile["class"].to_numpy(), tile["component"].factorize()[0]
        signs = np.array(tile["samples"].tolist(), np.int32)
        side = (tile["tile"] == tile["a"]).to_numpy()
        one_tile = bool((tile["a"] == tile["b"]).iloc[0])
        first, second, agreeing = [], [], []
        for i in range(len(tile) - 1):
            other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if not one_tile:
                other = other[side[other] != side[i]]
            same = signs[other] == signs[i]
            agree = same.sum(1)
            met = same.reshape(len(other), bands, signs.shape[1] // bands).all(2).any(1) & (agree >= least)
            first.append(np.full(int(met.sum()), i))
            second.append(other[met])
            agreeing.append(agree[met])
        if not first or not sum(map(len, first)):
            return none
        a, b = np.concatenate(first), np.concatenate(second)
        order = np.argsort(-np.concatenate(agreeing), kind="stable")
        a, b = a[order], b[order]
        column = pa.array(tile["text"], pa.large_string())
        found = [(piece.first, bags(piece)) for piece in slices(column)]
        own = (
            np.concatenate([row + shift for shift, (row, _, _) in found]),
            np.concatenate([bag[1] for _, bag in found]),
            np.concatenate([bag[2] for _, bag in found]),
        )
        sizes = np.bincount(own[0], minlength=len(tile))
        links = []
        while len(a):
            # The most promising pairs first; pairs that a link has joined since need no check.
            cost = np.cumsum(sizes[a] + sizes[b])
            n = max(1, int(np.searchsorted(cost, 1_000_000)))
            value = _similarity(own, own, a[:n], b[:n], factors.value)
            for x, y in zip(a[:n][value >= threshold - 1e-9], b[:n][value >= threshold - 1e-9], strict=True):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    links.append((names[x], names[y]))
            a, b = a[n:], b[n:]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        return pd.DataFrame(links, columns=["x", "y"], dtype=object) if links else none

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table if it has few rows; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, texts: DataFrame, factors, threshold: float) -> DataFrame:
    left = texts.select(F.col("class").alias("x"), F.col("text").alias("text_x"))
    right = texts.select(F.col("class").alias("y"), F.col("text").alias("text_y"))
    joined = pairs.join(right, "y").join(left, "x").select("x", "y", "text_x", "text_y")
    return staged(_similar(joined, factors, threshold), "verified")


def near_duplicates(
    documents: DataFrame,
    threshold: float = 0.8,
    bands: int = 10,
    rows: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`id_column`, group_id (least id of the group of linked texts), kept (id is group_id).

    Equal texts are in one group, and so are texts that verified links connect. A null text and
    one without words is alone in a group of its own id. Rows with a null id are told by
    their text as others are, but don't name a group; a group without any id has a null group_id
    and its rows are kept. Rows that repeat as a whole come out as often. Extra columns aren't read.
    """
    spark = documents.sparkSession
    factors = spark.sparkContext.broadcast(frequencies(documents, text_column))
    signed = staged(
        _signatures(documents, factors, bands * rows, id_column, text_column), "signatures"
    )
    usable = signed.where("samples IS NOT NULL")
    classes = staged(usable.groupBy("class").agg(F.first("samples").alias("samples")), "classes")
    keys = F.array(
        *[
            F.xxhash64(F.lit(b), F.slice("samples", 1 + b * rows, rows))
            for b in range(bands)
        ]
    )
    members = staged(
        classes.select("class", "samples", F.explode(keys).alias("bucket")), "members"
    )
    sizes = staged(members.groupBy("bucket").count().where("count > 1"), "buckets")
    shared = staged(members.drop("samples").join(sizes, "bucket"), "shared")
    # The text that meets most others is the likeliest source of the copies: it goes first.
    fame = staged(shared.groupBy("class").agg(F.sum("count").alias("fame")), "fame")
    ranked = shared.join(fame, "class").select("bucket", "class", "fame")
    heads = staged(
        ranked.groupBy("bucket").agg(F.max(F.struct("fame", "class"))["class"].alias("x")), "heads"
    )
    star = staged(
        shared.join(heads, "bucket").where("class != x").select("x", F.col("class").alias("y")).distinct(),
        "star",
    )
    texts = staged(
        documents.select(F.col(text_column).alias("text"), F.md5(text_column).alias("class"))
        .join(_small(fame.select("class")), "class", "left_semi")
        .groupBy("class")
        .agg(F.first("text").alias("text")),
        "texts",
    )
    links = _verified(star, texts, factors, threshold)
    grouped = staged(components(links), "groups")
    # Candidates that hang together but are in several groups: all that share a bucket are compared.
    wide = staged(components(star), "candidates").select(
        F.col("node").alias("class"), F.col("component").alias("wide")
    )
    labelled = staged(
        wide.join(grouped.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        ),
        "labelled",
    )
    open_groups = (
        labelled.groupBy("wide")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        .where("low != high")
        .select("wide", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    )
    tiled = (
        labelled.join(staged(open_groups, "open-groups"), "wide")
        .withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int"))
        .join(classes, "class")
        .join(texts, "class")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "wide", "class", "component", "samples", "text", "tile",
            F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
        )
    )
    # At similarity `threshold` fewer agreements than this have a probability of about 0.001.
    n = bands * rows
    least = int(n * (threshold - 3 * np.sqrt(threshold * (1 - threshold) / n)))
    more = staged(
        tiled.groupBy("wide", "a", "b").applyInPandas(
            _within(factors, threshold, bands, least), "x string, y string"
        ),
        "more-links",
    )
    if not more.isEmpty():
        grouped = staged(components(links.union(more)), "groups")
    named = (
        signed.where("samples IS NOT NULL")
        .join(grouped.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = named.groupBy("component").agg(F.min("id").alias("group_id"))
    told = named.join(least, "component").select("id", "group_id")
    alone = signed.where("samples IS NULL").select("id", F.col("id").alias("group_id"))
    kept = F.col("id").eqNullSafe(F.col("group_id"))
    return told.union(alone).select(F.col("id").alias(id_column), "group_id", kept.alias("kept"))
