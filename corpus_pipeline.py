"""A training-corpus pipeline: each stage takes documents and returns the documents it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmerge.llm import byte_bpe, queries, toxicity
from salesmerge.llm.decontamination import contamination
from salesmerge.llm.minhash_dedup import BROADCAST_ROWS, near_duplicates
from salesmerge.llm.rows import keys, staged
from salesmerge.llm.substring_dedup import remove_repeats
from salesmerge.session import configure

ORACLE_SQL = None  # a trained classifier and a tokenizer can't be written in SQL


def _with_keys(docs: DataFrame) -> DataFrame:
    a, b = keys("doc_id", "text")
    return docs.withColumns({"__a": a, "__b": b})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't reject; null and empty texts stay.

    The machine learns from the labelled documents of this stage's input.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = queries.toxicity_machine(docs.select("doc_id", "text"), labels)
    return toxicity.clean_documents(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id."""
    groups = staged(near_duplicates(docs), "near-duplicates")
    gone = staged(groups.where("NOT kept").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:  # of 8 bytes each
        gone = F.broadcast(gone)
    once = docs.join(gone, "doc_id", "left_anti")
    # A row that repeats with its id is one document, too.
    twice = staged(
        groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1"),
        "repeated-ids",
    )
    if twice.isEmpty():
        return once
    again = once.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.join(twice, "doc_id", "left_anti").unionByName(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 or more words that also stand elsewhere.

    A text that loses words is its kept words, one space between; other texts stay as they
    are. A document that loses every word goes.
    """
    cut = remove_repeats(docs)
    gone = F.col("n_removed") > 0
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    values = {"text": F.when(gone, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(gone, length).otherwise(F.col("n_chars"))
    return left.withColumns(values).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs.select("doc_id", "text"), benchmark)
    gone = found.where("contaminated").select(*keys("doc_id", "text")).distinct()
    gone = staged(gone, "contaminated")
    return _with_keys(docs).join(gone, ["__a", "__b"], "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document left, with their digest and that of the decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`, each written and read again before the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
