"""Matching the columns of unknown layers to report fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    COLUMN_HINTS,
    DATE_COLUMN_TYPES,
    EDGE_HINT_SCORE,
    EXACT_HINT_SCORE,
    INNER_HINT_SCORE,
    NUMERIC_COLUMN_TYPES,
    NUMERIC_TARGETS,
    TEXT_COLUMN_TYPES,
)
from ..functions.paths import normalize_column_name


def match_columns(columns: DataFrame) -> DataFrame:
    """Best column per (layer, target) of `columns(layer, ordinal, name, type)`.

    A column scores for a target by the first hint its name holds: more for an exact
    name, less for one at an end, least for one inside, and less the later the hint.
    Its type must suit the target. Equal scores go to the first column of the layer.
    The fifteen targets are a fixed list, tried on each column in place.
    """
    name = F.col("normalized")
    numeric = F.col("type").isin(*NUMERIC_COLUMN_TYPES)
    text = F.col("type").isin(*TEXT_COLUMN_TYPES)

    def score(target: str) -> Column:
        if target in NUMERIC_TARGETS:
            suits = numeric
        elif target == "sale_date":
            suits = numeric | text | F.col("type").isin(*DATE_COLUMN_TYPES)
        else:
            suits = numeric | text
        by_hint = [
            F.when(name == hint, EXACT_HINT_SCORE - i)
            .when(name.startswith(hint) | name.endswith(hint), EDGE_HINT_SCORE - i)
            .when(name.contains(hint), INNER_HINT_SCORE - i)
            for i, hint in enumerate(COLUMN_HINTS[target])
        ]
        return F.when(suits, F.coalesce(*by_hint))

    scores = F.array(
        *[F.struct(F.lit(t).alias("target"), score(t).alias("score")) for t in COLUMN_HINTS]
    )
    scored = (
        columns.filter("name <> ''")
        .withColumn("normalized", normalize_column_name(F.col("name")))
        .select("layer", "ordinal", "name", F.inline(F.filter(scores, lambda s: s["score"] > 0)))
    )
    return (
        scored.groupBy("layer", "target")
        .agg(
            F.max_by(
                F.struct("name", "score"), F.struct("score", -F.col("ordinal"))
            ).alias("best")
        )
        .select("layer", "target", F.col("best.name").alias("column"), F.col("best.score").alias("score"))
    )


def date_encoding(columns: DataFrame, matches: DataFrame) -> DataFrame:
    """How each layer stores its sale date: date, epoch_ms or string.

    A layer without a date column reads as date.
    """
    chosen = matches.filter("target = 'sale_date'").select("layer", F.col("column").alias("name"))
    # The first column of that name decides.
    types = (
        columns.join(chosen, ["layer", "name"])
        .groupBy("layer")
        .agg(F.min_by("type", "ordinal").alias("type"))
    )
    encoded = types.select(
        "layer",
        F.when(F.col("type").isin(*DATE_COLUMN_TYPES), "date")
        .when(F.col("type").isin(*NUMERIC_COLUMN_TYPES), "epoch_ms")
        .otherwise("string")
        .alias("encoding"),
    )
    layers = columns.select("layer").distinct()
    return layers.join(encoded, "layer", "left").withColumn(
        "encoding", F.coalesce(F.col("encoding"), F.lit("date"))
    )
