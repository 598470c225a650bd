"""One query for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmerge.llm import language_id, quality
from salesmerge.llm import toxicity as toxic
from salesmerge.llm.byte_bpe import round_trip
from salesmerge.llm.collocations import collocations
from salesmerge.llm.token_counts import token_counts
from salesmerge.llm.decontamination import contamination
from salesmerge.llm.embedding_dedup import near_duplicate_vectors
from salesmerge.llm.hard_negatives import hard_negatives
from salesmerge.llm.html_text import main_text
from salesmerge.llm.minhash_dedup import near_duplicates
from salesmerge.llm.packing import pack
from salesmerge.llm.substring_dedup import remove_repeats
from salesmerge.session import configure


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors by cosine."""
    return near_duplicate_vectors(_table(spark, folder, "embeddings"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole document under the byte-level BPE vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(_table(spark, folder, "documents"), path)


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that every whole document contains."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(documents, _table(spark, folder, "benchmark"))
    return found.select("doc_id", "contaminated", "items", "similarity")


def toxicity_machine(documents: DataFrame, labels: DataFrame) -> toxic.Machine:
    """Trained on the labelled documents of four folds out of five."""
    learning = labels.where(_fold(5) != 0).select(F.col("doc_id").alias("id"), "toxic")
    return toxic.fit(documents.select(F.col("doc_id").alias("id"), "text"), learning)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole document, learned from four fifths of the labelled rows."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    machine = toxicity_machine(documents, _table(spark, folder, "labels"))
    scored = toxic.toxicity(documents, machine)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near-duplicates of every whole document."""
    return near_duplicates(_table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight, quality and sampling of every whole document."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "doc_id")
    ratio = quality.fit(documents.withColumnRenamed("doc_id", "id"), labels, _fold(5) != 0)
    told = quality.classify(documents, ratio)
    return told.select("doc_id", (_fold(5) == 0).alias("held_out"), *told.columns[1:])


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every whole page."""
    return main_text(_table(spark, folder, "pages"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole document encoded by the ranks and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(_table(spark, folder, "documents"), path)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document, learned from three quarters of the labelled rows."""
    documents = _table(spark, folder, "documents")
    model = language_id.fit(documents, _fold(4) != 2)
    predicted = language_id.predict(documents, model, reject=False)
    return predicted.select("doc_id", (_fold(4) == 2).alias("held_out"), *predicted.columns[1:])


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every whole document without repeated passages of 35 words."""
    cut = remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of each language by their weakest cut, over all documents."""
    return collocations(_table(spark, folder, "documents"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every whole document in sequences of 4,096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(_table(spark, folder, "documents"), path)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    own = (
        op1_embedding_dedup, op2_token_counts, op3_decontamination, op4_toxicity, op5_minhash_dedup,
        op6_quality, op7_html_text, op8_byte_bpe, op9_language_id, op10_substring_dedup,
        op11_collocations, op12_best_fit_packing, op13_hard_negatives,
    )
    return {query.__name__: query for query in own}


_OP11 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\n\x0B\x0C\r]')) AS piece
    FROM documents),
lists AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3]) AS size FROM lists),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
           lambda i: list_aggregate(w[i:i + size - 1], 'string_agg', ' '))) AS phrase
    FROM sized WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
    SELECT *, list_aggregate(w[1:k], 'string_agg', ' ') AS lp, list_aggregate(w[k + 1:], 'string_agg', ' ') AS rp
    FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
    SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r,
           (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp AND x.size = c.k
    JOIN f y ON y.lang = c.lang AND y.phrase = c.rp AND y.size = c.size - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, a AS f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE size = 3)
    GROUP BY ALL),
ranked AS (
    SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
           row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
    WHERE g.f IS NULL OR 100 * g.f < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_OP13 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
    SELECT * FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
    SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score,
           n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INT AS rank
    FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB counterparts, where SQL can express the query."""
    return {"op11_collocations": _OP11, "op13_hard_negatives": _OP13}
