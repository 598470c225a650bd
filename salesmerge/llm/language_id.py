"""Language identification by interpolated Kneser-Ney character models.

Words (runs of letters, in lower case) are padded and read as character n-grams. One pass over
all learning rows counts the longest n-grams of each language; the counts meet in Spark, map-side
combined. Shorter n-grams get continuation counts. A model is a sorted array of n-gram hashes for
each order with the interpolated log probabilities of all languages side by side, and
the same for the contexts' back-off weights. Beyond `max_grams` n-grams the same model is made of
staged tables instead, and n-grams, words and texts meet their scores in joins; no n-gram is left out.

A text has the language of lowest cross-entropy per character over all of its words. The score
is a softmax of the cross-entropies; its temperature and, for each language, the
cross-entropy beyond which a text is rejected are fitted on all learning rows, by sums that meet
in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged
from salesmerge.llm.token_counts import LETTER, _classes
from salesmerge.llm.words import Memo, Slice, gather, mix, slices, span_hashes

UNKNOWN = "und"
PAD = 0x20
_FLOOR = 1e-7
_TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
_MULTIPLIERS = mix(np.arange(101, 133, dtype=np.uint64))


def _points(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, word starts and ends, and each text's first word."""
    texts = piece.data.tobytes()
    bounds = piece.offsets
    lowered = [texts[a:b].decode("utf-8").lower() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
    letter = _classes()[points] == LETTER
    edge = np.diff(np.concatenate([[0], letter.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum([len(text) + 1 for text in lowered])])
    return points, starts, ends, np.searchsorted(starts, offsets)


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Every place of each padded word, its end included, as a row of `order` code points."""
    lengths = ends - starts
    padded = lengths + order  # order - 1 pads in front, one behind
    out = np.full(int(padded.sum()), PAD, np.uint32)
    first = np.cumsum(padded) - padded
    out[gather(first + order - 1, lengths)] = points[gather(starts, lengths)]
    at = gather(first, lengths + 1)
    return out[at[:, None] + np.arange(order)]


def _hash(grams: np.ndarray) -> np.ndarray:
    total = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):  # from the right: shorter orders are suffixes
            total += (grams[:, -1 - k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k]
    return mix(total)


@dataclass
class Model:
    """Tables of each order from 1: n-gram hashes and log probabilities by language."""

    languages: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    back_off: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram, by language."""
        out = np.zeros((len(grams), len(self.languages)))
        rest = np.arange(len(grams))
        for k in range(self.order, 0, -1):
            part = grams[rest, self.order - k :]
            at, found = _find(self.keys[k - 1], _hash(part))
            out[rest[found]] += self.logs[k - 1][at[found]]
            rest, part = rest[~found], part[~found]
            if k > 1 and len(rest):
                at, found = _find(self.context_keys[k - 1], _hash(part[:, :-1]))
                out[rest[found]] += self.back_off[k - 1][at[found]]
        out[rest] += np.log(_FLOOR)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def build(grams: np.ndarray, language: np.ndarray, count: np.ndarray, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney tables from counted n-grams of the longest order."""
    order, n = grams.shape[1], len(languages)
    model = Model(languages, order)
    levels = []
    for k in range(order, 0, -1):
        levels.append((k, grams, language, count))
        if k > 1:  # a shorter n-gram counts its different left neighbours
            keys = np.stack([_hash(grams[:, 1:]), language.astype(np.uint64)])
            _, one, count = np.unique(keys, axis=1, return_index=True, return_counts=True)
            grams, language = grams[one, 1:], language[one]
    lower: np.ndarray | None = None
    for k, rows, owner, counted in reversed(levels):
        hashes = _hash(rows)
        keys, one, at = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.zeros((len(keys), n))
        np.add.at(number, (at, owner), counted)
        if k == 1:
            whole = number.sum(0, keepdims=True)
            probability = (number + 0.5) / (whole + 0.5 * (len(keys) + 1))
            context_keys, weight = np.zeros(0, np.uint64), np.ones((0, n))
        else:
            ones, twos = ((number == c).sum(0) for c in (1, 2))
            discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
            contexts = _hash(rows[one, :-1])
            context_keys, inside = np.unique(contexts, return_inverse=True)
            whole, kinds = np.zeros((len(context_keys), n)), np.zeros((len(context_keys), n))
            np.add.at(whole, inside, number)
            np.add.at(kinds, inside, number > 0)
            weight = np.where(whole > 0, discount * kinds / np.maximum(whole, 1), 1.0)
            at, _ = _find(model.keys[-1], _hash(rows[one, 1:]))
            probability = (
                np.maximum(number - discount, 0) / np.maximum(whole, 1)[inside]
                + weight[inside] * lower[at]
            )
        lower = probability
        model.keys.append(keys)
        model.logs.append(np.log(np.maximum(probability, _FLOOR)).astype(np.float32))
        model.context_keys.append(context_keys)
        model.back_off.append(np.log(np.maximum(weight, _FLOOR)).astype(np.float32))
    return model


@dataclass
class TableModel:
    """The same model as tables: (gram, p) of each order from 1, (gram, w) of the contexts."""

    languages: list[str]
    order: int
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame | None] = field(default_factory=list)
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def score(self, grams: DataFrame) -> DataFrame:
        """gram, s: log probability of the last character of each n-gram, by language."""
        n, order = len(self.languages), self.order
        told = grams.select("gram", F.array_repeat(F.lit(float(np.log(_FLOOR))), n).alias("s"))
        for k in range(1, order + 1):
            own = self.grams[k - 1].select(F.col("gram").alias("__g"), "p")
            told = told.join(own, F.substring("gram", order - k + 1, k) == F.col("__g"), "left")
            logs = F.when(F.col("p").isNotNull(), _logs(F.col("p")))
            if k > 1:
                weights = self.contexts[k - 1].select(F.col("gram").alias("__c"), "w")
                told = told.join(
                    weights, F.substring("gram", order - k + 1, k - 1) == F.col("__c"), "left"
                )
                backed = F.zip_with(_logs(F.col("w")), F.col("s"), lambda w, s: w + s)
                logs = logs.when(F.col("w").isNotNull(), backed)
            told = told.select("gram", logs.otherwise(F.col("s")).alias("s"))
        return told


def _logs(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(F.greatest(x, F.lit(_FLOOR))))


def _beside(rows: DataFrame, languages: list[str], *values: str) -> DataFrame:
    """gram and, for each of `values`, an array by language (0 where a language lacks the n-gram)."""
    names = F.array(*[F.lit(x) for x in languages])

    def dense(value: str) -> Column:
        entries = F.map_from_entries(F.collect_list(F.struct("lang", F.col(value).cast("double"))))
        # One entry for each language at most.
        return F.transform(names, lambda x: F.coalesce(F.try_element_at(entries, x), F.lit(0.0)))

    return rows.groupBy("gram").agg(*[dense(v).alias(v) for v in values])


def build_tables(counted: DataFrame, languages: list[str], order: int) -> TableModel:
    """What `build` makes, from the staged counts (lang, gram, n) of any number of n-grams."""
    levels = {order: counted}
    for k in range(order - 1, 0, -1):  # a shorter n-gram counts its different left neighbours
        gram = F.substring("gram", 2, k).alias("gram")
        shorter = levels[k + 1].groupBy("lang", gram).agg(F.count("*").alias("n"))
        levels[k] = staged(shorter, f"grams-{k}")
    model = TableModel(languages, order)

    def by_language(rows: DataFrame, value: Column) -> Column:
        told = dict(rows.groupBy("lang").agg(value.cast("double")).collect())
        return F.array(*[F.lit(told.get(x, 0.0)) for x in languages])

    for k in range(1, order + 1):
        rows = levels[k]
        number = _beside(rows, languages, "n")
        if k == 1:
            whole = by_language(rows, F.sum("n"))
            kinds = rows.select("gram").distinct().count()
            p = F.zip_with("n", whole, lambda x, w: (x + 0.5) / (w + 0.5 * (kinds + 1)))
            model.contexts.append(None)
            model.grams.append(staged(number.select("gram", p.alias("p")), "level-1"))
            continue
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = by_language(
            rows, F.least(F.greatest(ones / F.greatest(ones + 2 * twos, F.lit(1)), F.lit(0.1)), F.lit(0.9))
        )
        context = F.substring("gram", 1, k - 1).alias("gram")
        sums = rows.groupBy("lang", context).agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
        weight = F.transform(
            "whole",
            lambda x, i: F.when(x > 0, F.get(discount, i) * F.get("kinds", i) / x).otherwise(1.0),
        )
        contexts = staged(
            _beside(sums, languages, "whole", "kinds").select("gram", "whole", weight.alias("w")),
            f"contexts-{k}",
        )
        lower = model.grams[-1].select(F.col("gram").alias("__l"), F.col("p").alias("lower"))
        inside = contexts.select(F.col("gram").alias("__c"), "whole", "w")
        joined = number.join(inside, F.substring("gram", 1, k - 1) == F.col("__c")).join(
            lower, F.substring("gram", 2, k - 1) == F.col("__l")
        )
        p = F.transform(
            "n",
            lambda x, i: F.greatest(x - F.get(discount, i), F.lit(0.0))
            / F.greatest(F.get("whole", i), F.lit(1.0))
            + F.get("w", i) * F.get("lower", i),
        )
        model.contexts.append(contexts)
        model.grams.append(staged(joined.select("gram", p.alias("p")), f"level-{k}"))
    return model


def _of_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between languages, however many there are."""
    with np.errstate(over="ignore"):
        return mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))


def count_grams(rows: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """lang, gram (its characters), n: how often each n-gram occurs in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            kinds = names.dictionary
            owners = names.indices.to_numpy()
            for piece in slices(batch.column(0)):
                points, starts, ends, rows = _points(piece)
                if not len(starts):
                    continue
                owner = np.repeat(owners[piece.first : piece.last], np.diff(rows))
                keys = _of_owner(span_hashes(points, starts, ends), owner)
                _, one, often = np.unique(keys, return_index=True, return_counts=True)
                grams = _grams(points, starts[one], ends[one], order)
                places = (ends - starts)[one] + 1
                owner, often = np.repeat(owner[one], places), np.repeat(often, places)
                _, first, at = np.unique(
                    _of_owner(_hash(grams), owner), return_index=True, return_inverse=True
                )
                shown = np.ascontiguousarray(grams[first]).view(f"<U{order}")[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        kinds.take(pa.array(owner[first])),
                        pa.array(shown.tolist(), pa.string()),
                        pa.array(np.bincount(at, often).astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    counted = rows.select(text, lang).mapInArrow(count, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _text_scores(piece: Slice, model: Model, memo: Memo, known: list) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probability by text and language, and the number of places by text."""
    points, starts, ends, rows = _points(piece)
    n = len(model.languages)
    if not len(starts):
        return np.zeros((len(rows) - 1, n)), np.zeros(len(rows) - 1, np.int64)
    distinct, one, back = np.unique(
        span_hashes(points, starts, ends), return_index=True, return_inverse=True
    )
    if known[1] + len(distinct) > len(known[0]):  # all memory used: begin again
        memo.keys[:] = 0
        memo.values[:] = -1
        known[1] = 0
        if len(distinct) > len(known[0]):
            known[0] = np.zeros((len(distinct), n))
    at = memo.get(distinct)
    new = np.flatnonzero(at < 0)
    if len(new):
        lengths = (ends - starts)[one[new]] + 1
        places = model.score(_grams(points, starts[one[new]], ends[one[new]], model.order))
        at[new] = known[1] + np.arange(len(new))
        known[0][at[new]] = np.add.reduceat(places, np.cumsum(lengths) - lengths, axis=0)
        memo.put(distinct[new], at[new])
        known[1] += len(new)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    each = known[0][at]
    sums = np.stack([np.bincount(row, each[back, k], len(rows) - 1) for k in range(n)], 1)
    places = np.bincount(row, ends - starts + 1, len(rows) - 1).astype(np.int64)
    return sums, places


#: Scores of the most frequent words that are broadcast; the other words' scores are joined.
HEAD = 2_000_000


def _word_scores(rows: DataFrame, model: TableModel, text_column: str) -> DataFrame:
    """word (its hash), n (how often it occurs) and s (summed log probability by language)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(0)):
                points, starts, ends, _ = _points(piece)
                if not len(starts):
                    continue
                keys, one, often = np.unique(
                    span_hashes(points, starts, ends), return_index=True, return_counts=True
                )
                shown = [
                    points[a:b].tobytes().decode("utf-32-le")
                    for a, b in zip(starts[one], ends[one], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(shown, pa.string()), pa.array(often)],
                    names=["word", "shown", "n"],
                )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                points, starts, ends, rows = _points(piece)
                places = _grams(points, starts, ends, model_order)
                shown = np.ascontiguousarray(places).view(f"<U{model_order}")[:, 0]
                owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows)) + piece.first
                at = np.repeat(owner, ends - starts + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(shown.tolist(), pa.string())],
                    names=["word", "gram"],
                )

    model_order = model.order
    told = rows.select(text_column).mapInArrow(words, "word bigint, shown string, n bigint")
    different = staged(
        told.groupBy("word").agg(F.first("shown").alias("shown"), F.sum("n").alias("n")), "words"
    )
    parts = different.select("word", "shown").mapInArrow(grams, "word bigint, gram string")
    scored = staged(model.score(parts.select("gram").distinct()), "gram-scores")
    sums = F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(len(model.languages))])
    summed = parts.join(scored, "gram").groupBy("word").agg(sums.alias("s"))
    return staged(different.select("word", "n").join(summed, "word"), "word-scores")


def _table_entropies(rows: DataFrame, model: TableModel, id_column: str, text_column: str) -> DataFrame:
    """`cross_entropies` by a model of tables.

    Scores of the most frequent words are broadcast and summed where the texts are read; each text
    keeps the list of its other words, which meet their scores in a join.
    """
    n = len(model.languages)
    scored = _word_scores(rows, model, text_column)
    first = scored.orderBy(F.desc("n"), "word").limit(HEAD // n).select("word", "s").toArrow()
    keys = first["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    scores = np.array(first["s"].to_pylist(), np.float64).reshape(len(keys), n)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], scores[order]))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, values = shared.value
        for batch in batches:
            for piece in slices(batch.column(1)):
                points, starts, ends, rows = _points(piece)
                size = len(rows) - 1
                row = np.repeat(np.arange(size), np.diff(rows))
                places = np.bincount(row, ends - starts + 1, size).astype(np.int64)
                own, back = np.unique(span_hashes(points, starts, ends), return_inverse=True)
                pair, often = np.unique(row * max(1, len(own)) + back, return_counts=True)
                row, word = pair // max(1, len(own)), pair % max(1, len(own))
                at, found = _find(head, own)
                here = found[word]
                part = values[at[word[here]]] * often[here, None]
                sums = np.stack([np.bincount(row[here], part[:, k], size) for k in range(n)], 1)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row[~here], minlength=size))])
                bounds = pa.array(bounds.astype(np.int32))
                rest = own[word[~here]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, size),
                        pa.array(places),
                        pa.array(sums.tolist(), pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(bounds, pa.array(rest)),
                        pa.ListArray.from_arrays(bounds, pa.array(often[~here].astype(np.int64))),
                    ],
                    names=["id", "places", "sums", "words", "often"],
                )

    narrow = rows.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    texts = staged(
        narrow.mapInArrow(
            known,
            f"`{id_column}` {kind}, places bigint, sums array<double>, words array<bigint>, often array<bigint>",
        ).withColumn("__row", F.monotonically_increasing_id()),
        "text-words",
    )
    open_words = texts.select("__row", F.explode(F.arrays_zip("words", "often")).alias("x"))
    sums = F.array(*[F.sum(F.get("s", F.lit(k)) * F.col("x.often")) for k in range(n)])
    rest = (
        open_words.join(scored.select("word", "s"), F.col("x.words") == F.col("word"))
        .groupBy("__row")
        .agg(sums.alias("more"))
    )
    more = F.coalesce("more", F.array_repeat(F.lit(0.0), n))
    rates = F.zip_with("sums", more, lambda a, b: -(a + b) / F.greatest("places", F.lit(1)))
    return texts.join(rest, "__row", "left").select(id_column, "places", rates.alias("entropies"))


def cross_entropies(
    rows: DataFrame, model: Model | TableModel, id_column: str, text_column: str
) -> DataFrame:
    """id, places (characters with word ends), entropies (array by language) of whole texts."""
    if isinstance(model, TableModel):
        return _table_entropies(rows, model, id_column, text_column)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        memo, known = Memo(19), [np.zeros((1 << 18, len(own.languages))), 0]
        for batch in batches:
            for piece in slices(batch.column(1)):
                sums, places = _text_scores(piece, own, memo, known)
                rates = -sums / np.maximum(places, 1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array(places),
                        pa.array(rates.tolist(), pa.list_(pa.float64())),
                    ],
                    names=["id", "places", "entropies"],
                )

    narrow = rows.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(score, f"`{id_column}` {kind}, places bigint, entropies array<double>")


def fit(
    documents: DataFrame,
    learn: Column,
    order: int = 5,
    max_grams: int = 2_000_000,
    text_column: str = "text",
    lang_column: str = "lang",
) -> Model | TableModel:
    """Models of all languages among the rows where `learn` holds.

    All learning rows are counted. A model of more than `max_grams` different n-grams isn't
    broadcast: it stays in tables, with every n-gram. Temperature and rejection limits come from all
    learning rows with letters. No learning row: a model of no language.
    """
    rows = documents.where(
        learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()
    ).select(text_column, lang_column)
    counted = staged(count_grams(rows, text_column, lang_column, order), "grams")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], order)
    if counted.count() > max_grams:
        model = build_tables(counted, languages, order)
    else:
        kept = counted.toArrow()
        names = kept["lang"].combine_chunks().dictionary_encode()
        place = np.array([languages.index(x) for x in names.dictionary.to_pylist()])
        text = "".join(kept["gram"].to_pylist()).encode("utf-32-le")
        grams = np.frombuffer(text, np.uint32).reshape(-1, order)
        model = build(grams, place[names.indices.to_numpy()], kept["n"].to_numpy(), languages)
    # Calibrate: every learning row is scored, and only sums by language leave a task.
    scored = cross_entropies(rows, model, lang_column, text_column).where("places > 0")
    truth = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang_column)).cast("int")
    rated = scored.select(
        F.col(lang_column).alias("lang"),
        "entropies",
        F.array_min("entropies").alias("least"),
        F.element_at("entropies", truth).alias("own"),
    )
    least, own = F.col("least"), F.col("own")
    losses = [
        F.sum(-F.log(F.greatest(F.exp((least - own) * t) / _total(least, t), F.lit(1e-9))))
        for t in _TEMPERATURES
    ]
    told = rated.groupBy("lang").agg(
        F.avg("own").alias("mean"), F.stddev_pop("own").alias("std"), F.array(*losses).alias("losses")
    ).collect()
    model.limits = np.full(len(languages), np.inf)
    for r in told:
        model.limits[languages.index(r["lang"])] = r["mean"] + 4 * r["std"] + 0.5
    if told:
        model.temperature = _TEMPERATURES[int(np.argmin(np.sum([r["losses"] for r in told], axis=0)))]
    return model


def _total(least: Column, temperature: float) -> Column:
    """What the softmax of `entropies` is divided by, relative to the least of them."""
    return F.aggregate(
        "entropies", F.lit(0.0), lambda sum_, x: sum_ + F.exp((least - x) * temperature)
    )


def predict(
    documents: DataFrame,
    model: Model | TableModel,
    reject: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`id_column`, lang_pred, score (0 to 1), rejected, cross_entropy (nats per character).

    A null text, one without letters, and any text under a model of no language is `und`
    with score 0. With `reject`, so is a text beyond its language's calibrated limit; else it only
    has `rejected`. Ties go to the first language by name. One row in, one row out.
    """
    if not model.languages:
        none = F.lit(None).cast("double")
        return documents.select(
            id_column, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(False).alias("rejected"), none.alias("cross_entropy"),
        )
    rated = cross_entropies(documents, model, id_column, text_column)
    least = F.array_min("entropies")
    best = F.array_position("entropies", least).cast("int")
    names = F.array(*[F.lit(x) for x in model.languages])
    limits = F.array(*[F.lit(float(x)) for x in model.limits])
    total = _total(least, model.temperature)
    has = F.col("places") > 0
    beyond = has & (least > F.element_at(limits, best))
    out = has & ~beyond if reject else has
    return rated.select(
        id_column,
        F.when(out, F.element_at(names, best)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(out, 1 / total).otherwise(0.0).alias("score"),
        beyond.alias("rejected"),
        F.when(has, least).alias("cross_entropy"),
    )
