"""Benchmark passages inside documents, found by SimHash windows; DataFrame functions only.

A window has as many words as a benchmark item. Every window is fingerprinted that holds enough
shingles of five words of the items of its size, at whatever place in them, to reach the
threshold: with fewer the similarity lies below it. A fingerprint is 64 bits of SimHash over the
window's shingles. The search among the items knows nothing of the shared shingles: fingerprints
are cut into `radius + 1` blocks, so two within the radius agree in a block (pigeonhole), windows and
items of one size meet by block, and the Hamming distance is checked. Exact similarity of the
weighted shingles (weight: how often the shingle occurs) decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import keys, staged

SHINGLE = 5
BITS = 64
#: Up to so many rows a table of the benchmark's side is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda word: word != "")


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; none for fewer words."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - SHINGLE + 1),
            lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits: bit b is set if most of the hashes (each as often as it occurs) have it."""
    size = F.size(shingles)

    def bit(b: Column) -> Column:
        ones = F.aggregate(
            shingles,
            F.lit(0),
            lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"),
        )
        return F.when(2 * ones > size, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(0)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("bigint"),
        lambda all_, b: all_.bitwiseOR(bit(b)),
    )


def _blocks(fingerprint: Column, radius: int) -> Column:
    """Each block's number and bits, packed; the widths differ by one bit at most."""
    bounds = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *[
            F.shiftrightunsigned(fingerprint, low).bitwiseAND((1 << (high - low)) - 1)
            + F.lit(k << 32)
            for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
        ]
    )


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of hashes, a hash weighing its occurrences."""

    def times(hashes: Column, h: Column) -> Column:
        return F.size(F.filter(hashes, lambda other: other == h))

    shared = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h))
    )
    return shared / (F.size(a) + F.size(b) - shared)


def _starts(at: Column, n: Column, size: Column, length: Column, threshold: float) -> Column:
    """Starts of all windows with enough shared shingles (sorted places `at`) for the threshold."""
    own, item = length - (SHINGLE - 1), size - (SHINGLE - 1)
    need = F.ceil(F.lit(float(threshold)) * (own + item) / F.lit(1.0 + threshold) - F.lit(1e-9))
    need = F.greatest(F.lit(1), need.cast("int"))

    def run(i: Column) -> Column:
        # Windows that hold the i-th shared place and the next need - 1, and none before it.
        low = F.greatest(
            F.lit(0),
            F.element_at(at, i + need - 1) - own + 1,
            F.when(i > 1, F.element_at(at, F.greatest(i - 1, F.lit(1))) + 1).otherwise(0),
        )
        high = F.least(F.element_at(at, i), n - length)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    enough = F.size(at) >= need
    return F.when(
        enough, F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - need + 1), run))
    ).otherwise(F.array().cast("array<int>"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    radius: int = 19,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(a, b, item, first_word, similarity): the windows of row keys that match an item.

    Items of fewer than five words have no shingle and are never found; a document shorter than
    an item is one window. Staged. The radius misses a pair of similarity 0.8 with a probability
    of about 0.0003, and less above.
    """
    items = benchmark.select(
        F.col(item_column).alias("item"), _words(F.col(item_text_column)).alias("words")
    ).select("item", F.size("words").alias("size"), _shingles(F.col("words")).alias("shingles"))
    items = staged(
        items.where(F.size("shingles") > 0).withColumn("print", simhash(F.col("shingles"))), "items"
    )
    places = items.select("size", F.explode("shingles").alias("hash")).distinct()
    places = _small(staged(places, "places"))

    keyed = documents.select(*keys(id_column, text_column), F.col(text_column).alias("text"))
    hits = (
        keyed.select("__a", "__b", _words(F.col("text")).alias("words"))
        .select("__a", "__b", F.size("words").alias("n"), "words")
        # Not a column first: Spark would filter it by its size, its words split anew for each shingle.
        .select("__a", "__b", "n", F.posexplode(_shingles(F.col("words"))).alias("at", "hash"))
        .join(places, "hash")
        .groupBy("__a", "__b", "n", "size")
        .agg(F.sort_array(F.collect_set("at")).alias("at"))
        .withColumn("length", F.least("size", "n"))
        .withColumn("starts", _starts(F.col("at"), F.col("n"), F.col("size"), F.col("length"), threshold))
        .where(F.size("starts") > 0)
        .groupBy("__a", "__b")
        .agg(F.collect_list(F.struct("size", "length", "starts")).alias("windows"))
    )
    hits = staged(hits, "hits")

    marked = (
        keyed.join(_small(hits), ["__a", "__b"])
        .select("__a", "__b", "windows", _words(F.col("text")).alias("words"))
        .select("__a", "__b", "windows", _shingles(F.col("words")).alias("all"))
    )
    shown = F.transform(
        "windows",
        lambda w: F.transform(
            w["starts"],
            lambda s: F.struct(
                w["size"].alias("size"),
                s.alias("start"),
                F.slice(F.col("all"), s + 1, w["length"] - (SHINGLE - 1)).alias("shingles"),
            ),
        ),
    )
    prints = (
        marked.select("__a", "__b", F.explode(F.flatten(shown)).alias("w"))
        .select("__a", "__b", "w.size", "w.start", "w.shingles")
        .withColumn("print", simhash(F.col("shingles")))
    )
    prints = staged(prints, "prints")

    blocks = items.select("item", "size", F.col("print").alias("item_print"),
                          F.explode(_blocks(F.col("print"), radius)).alias("block"))
    near = (
        prints.select("__a", "__b", "size", "start", "print",
                      F.explode(_blocks(F.col("print"), radius)).alias("block"))
        .join(_small(staged(blocks, "blocks")), ["size", "block"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("__a", "__b", "size", "start", "item")
        .distinct()
    )
    bodies = items.select("item", "size", F.col("shingles").alias("item_shingles"))
    similarity = weighted_similarity(F.col("shingles"), F.col("item_shingles"))
    verified = (
        near.join(prints.drop("print"), ["__a", "__b", "size", "start"])
        .join(_small(bodies), ["item", "size"])
        .select(
            F.col("__a").alias("a"),
            F.col("__b").alias("b"),
            "item",
            F.col("start").alias("first_word"),
            similarity.alias("similarity"),
        )
        .where(F.col("similarity") >= threshold)
    )
    return staged(verified, "matches")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    radius: int = 19,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """All columns of the rows, with contaminated, items (sorted, distinct) and similarity (0 if none).

    A null or empty text is clean. Rows that repeat come out as often, with equal results. A
    column of the input with one of the three names is replaced.
    """
    found = matches(
        documents, benchmark, threshold, radius, id_column, text_column, item_column, item_text_column
    )
    each = found.groupBy("a", "b").agg(
        F.sort_array(F.collect_set("item")).alias("__items"), F.max("similarity").alias("__similarity")
    )
    rest = [c for c in documents.columns if c not in ("contaminated", "items", "similarity")]
    keyed = documents.select(*rest, *keys(id_column, text_column))
    joined = keyed.join(
        _small(staged(each, "contaminated")),
        (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")),
        "left",
    )
    none = F.array().cast(each.schema["__items"].dataType)
    return joined.select(
        *rest,
        F.col("__similarity").isNotNull().alias("contaminated"),
        F.coalesce("__items", none).alias("items"),
        F.coalesce("__similarity", F.lit(0.0)).alias("similarity"),
    )
