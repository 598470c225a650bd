"""Recognizing known places in prose, and reports out of prose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import normalize_municipality
from ..functions.prose import extract_address, extract_price, parse_feed_date
from ..functions.text import blank_to_null
from ..schema import Area, local_frame
from .name_trie import NameTrie, is_word, least_names


@dataclass(frozen=True)
class Place:
    """A configured place name: as compared, as words, and as shown."""

    name: str
    words: str
    display: str
    ord: int


# Names of one pattern; more go into a trie.
PATTERN_NAMES = 500
_WORDS = r"(?U)[^\w]+"


def known_places(
    spark: SparkSession, areas: Sequence[Area], extra: Sequence[str] = ()
) -> list[Place]:
    """The place names to look for, out of the configuration.

    A name configured twice keeps its first position and its last spelling.
    """
    listed = [m for area in areas for m in area.municipalities] + list(extra)
    frame = local_frame(spark, [(m,) for m in listed], "display STRING").withColumn(
        "name", normalize_municipality(F.col("display"))
    )
    places: dict[str, Place] = {}
    for row in frame.withColumn("words", F.array_join(F.split("name", _WORDS), " ")).collect():
        if row["name"]:
            ord_ = places[row["name"]].ord if row["name"] in places else len(places)
            places[row["name"]] = Place(row["name"], row["words"], row["display"], ord_)
    return list(places.values())


def gazetteer_match(texts: DataFrame, places: Sequence[Place]) -> DataFrame:
    """Add `place`: the longest known name that stands as whole words in `text`.

    Ties go to the name listed first. A short list is one pattern that finds, at every word, the
    longest name that starts there. A long one is a trie of tokens, whose time doesn't depend on
    the number of names. No join, no shuffle, and no key to join on.
    """
    if not places:
        return texts.withColumn("place", F.lit(None).cast("string"))
    by_length = list(enumerate(sorted(places, key=lambda p: (-len(p.name), p.ord))))
    normalized = texts.withColumn("normalized", normalize_municipality(F.col("text")))
    if len(by_length) <= PATTERN_NAMES:
        found = _by_pattern(by_length)
    else:
        # A name that begins or ends beside its words isn't bounded by tokens.
        odd = [p for p in by_length if not (is_word(ord(p[1].name[0])) and is_word(ord(p[1].name[-1])))]
        skipped = {number for number, _ in odd}
        tokens = [p for p in by_length if p[0] not in skipped]
        firsts = [_by_pattern(odd[k : k + PATTERN_NAMES]) for k in range(0, len(odd), PATTERN_NAMES)]
        if tokens:
            firsts.append(_by_trie(texts.sparkSession, tokens))
        found = F.array_min(F.array(*firsts))
    return normalized.withColumn("place", found["display"]).drop("normalized")


def _by_pattern(places: Sequence[tuple[int, Place]]) -> Column:
    """struct(ord, display) of the least-numbered place, found by one pattern."""
    names = "|".join(r"\Q" + p.name + r"\E" for _, p in places)
    found = F.regexp_extract_all("normalized", F.lit(rf"(?U)\b(?=({names})\b)"), F.lit(1))
    # Place in the sorted list: the smallest is the longest name, listed first.
    order = F.create_map(*[F.lit(x) for k, (_, p) in enumerate(places) for x in (p.name, k + 1)])
    shown = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(p.display).alias("display")) for n, p in places])
    return F.try_element_at(shown, F.array_min(_looked_up(found, order)))


def _by_trie(spark: SparkSession, places: Sequence[tuple[int, Place]]) -> Column:
    """struct(ord, display) of the least-numbered place, found by a trie in Arrow batches."""
    trie = NameTrie([p.name for _, p in places])
    # As large as the configured names.
    shared = spark.sparkContext.broadcast((trie, [p.display for _, p in places], [n for n, _ in places]))

    @F.arrow_udf("struct<ord:int,display:string>")
    def least(column: pa.Array) -> pa.Array:
        return least_names(column, *shared.value)

    return least(F.col("normalized"))


def _looked_up(found: Column, order: Column) -> Column:
    return F.transform(found, lambda name: F.try_element_at(order, name))


def extract_reports_from_text(
    entries: DataFrame, source: str, places: Sequence[Place], county: str | None = None
) -> DataFrame:
    """Feed entries (record_ord, title, summary, link, published) to raw reports.

    An entry without both an address and a price is no sale and is dropped.
    """
    texts = entries.withColumn(
        "text",
        F.concat(
            F.coalesce(F.col("title"), F.lit("")), F.lit(". "), F.coalesce(F.col("summary"), F.lit(""))
        ),
    )
    found = texts.withColumns(
        {
            "address": extract_address(F.col("text")),
            "price_num": extract_price(F.col("text")).cast("double"),
        }
    )
    row = F.struct(*found.columns)
    sold = found.select(
        F.inline(
            F.filter(
                F.array(row), lambda r: r["address"].isNotNull() & r["price_num"].isNotNull()
            )
        )
    )
    placed = gazetteer_match(sold, places)
    return placed.select(
        "record_ord",
        F.lit(source).alias("source"),
        "address",
        "price_num",
        parse_feed_date(F.col("published")).cast("string").alias("sale_date_text"),
        F.col("place").alias("municipality"),
        F.lit(county).cast("string").alias("county"),
        blank_to_null(F.col("link")).alias("source_url"),
        F.to_json(F.struct("title", "summary"), {"ignoreNullFields": "false"}).alias("raw"),
    )
