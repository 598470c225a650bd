"""Phrase collocations: frequent phrases whose words keep together more than chance would have it.

The first pass finds which n-grams can be frequent at all, in bounded memory. The space of n-gram
hashes is cut into cells; each cell has a Misra-Gries summary whose capacity exceeds the cell's
mass (its number of n-gram occurrences) divided by the threshold. Summaries of parts of the
corpus merge: counts add up, and a summary over its capacity gives up the same amount of every
counter. What is given up in total stays below the threshold, so each n-gram that reaches it
survives. Survivors set a bit of a filter of fixed size. The second pass counts, by their text,
the n-grams that pass the filter: exactly, and combined before the shuffle.
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
from salesmerge.llm.words import Slice, gather, mix, slices, words

#: Bytes between words, and bytes that end a piece.
BLANKS = frozenset(b"\x20\x09")
STOPS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
#: N-gram occurrences of a hash cell, about, and the most cells.
CELL_MASS = 1 << 20
MAX_CELL_BITS = 20
#: A summary's capacity as a multiple of mass / threshold: the larger, the fewer false survivors.
SLACK = 4
#: Bits of the filter, as a power of two: 16 MB. Fuller, it only lets more through to the count.
FILTER_BITS = 27
#: Counters that a task holds before it hands its summaries on, and those of a row of them.
HELD, ROW_COUNTERS = 1 << 20, 1 << 10
#: Rows of an Arrow batch: at most 6 MB of summaries, about as many texts as a slice holds.
BATCH_ROWS = 512
#: Bytes of text that a task reads at once; a longer text is read whole.
SLICE = 1 << 20
#: Shares in which the phrases that begin or end with a word meet the word's count.
SALTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


# --- n-grams of a slice ---------------------------------------------------------------------


@dataclass
class Ngrams:
    """All n-grams of a slice: hash, first word, number of words; and the words themselves.

    `text` holds the slice's words, lower-cased, with one space after each; word w stands at
    `starts[w]` to `ends[w]`.
    """

    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def check(self) -> np.ndarray:
        """A second, independent hash: that of each n-gram's bytes."""
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.text), _STEP)]))
            sums = np.zeros(len(self.text) + 1, np.uint64)
            np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            a, b = self.starts[self.first], self.ends[self.first + self.size - 1]
            # Aligned to the end of the text instead of divided by the power of the start.
            return (sums[b] - sums[a]) * up[len(self.text) - a]

    def phrases(self, at: np.ndarray) -> pa.Array:
        """Texts of the n-grams with these numbers."""
        a = self.starts[self.first[at]]
        sizes = self.ends[self.first[at] + self.size[at] - 1] - a
        data = self.text[gather(a, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STOP = np.isin(np.arange(256), sorted(STOPS))


def ngrams(piece: Slice, longest: int, seeds: np.ndarray) -> Ngrams:
    """N-grams of 1 to `longest` words within the pieces of each row; `seeds` has one number a row."""
    read = words(piece, BLANKS | STOPS, fold=True)
    n = len(read.starts)
    row = np.repeat(np.arange(len(read.rows) - 1), np.diff(read.rows))
    stops = np.cumsum(_STOP[piece.data])[read.starts] if n else np.zeros(0, np.int64)
    lengths = read.ends - read.starts
    data = np.append(piece.data, np.uint8(0x20))
    text = _LOWER[data[gather(read.starts, lengths + 1)]]
    ends = np.cumsum(lengths + 1) - 1
    text[ends] = 0x20
    total = seeds[row] if n else np.zeros(0, np.uint64)
    hashes, firsts, sizes = [], [], []
    with np.errstate(over="ignore"):
        for size in range(1, longest + 1):
            m = max(0, n - size + 1)
            total = mix(total[:m] * _ODD + read.hashes[size - 1 : size - 1 + m])
            whole = (row[:m] == row[size - 1 : n]) & (stops[:m] == stops[size - 1 : n])
            at = np.flatnonzero(whole)
            hashes.append(total[at] + np.uint64(size))
            firsts.append(at)
            sizes.append(np.full(len(at), size, np.int64))
    return Ngrams(
        mix(np.concatenate(hashes)), np.concatenate(firsts), np.concatenate(sizes),
        text, ends - lengths, ends, read.rows,
    )


def _seed(lang: str) -> int:
    value = np.uint64(0)
    with np.errstate(over="ignore"):
        for byte in lang.encode():
            value = mix(np.array([value * _ODD + np.uint64(byte + 1)], np.uint64))[0]
    return int(value)


def _read(batches: Iterator[pa.RecordBatch], longest: int):
    """(n-grams, language of each row) of bounded slices of (lang, text)."""
    seeds: dict[str, int] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names = coded.dictionary.to_pylist()
        for name in names:
            if name not in seeds:
                seeds[name] = _seed(name)
        codes = coded.indices.to_numpy()
        own = np.array([seeds[name] for name in names], np.uint64)
        for piece in slices(batch.column(1), SLICE):
            code = codes[piece.first : piece.last]
            yield ngrams(piece, longest, own[code]), code, names


# --- mass of the cells ----------------------------------------------------------------------


def _masses(texts: DataFrame, longest: int, bits: int) -> DataFrame:
    """(lang, cell, n): occurrences by hash cell (no language), and words by language (no cell)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, by_lang = np.zeros(1 << bits, np.int64), {}
        for found, code, names in _read(batches, longest):
            mass += np.bincount((found.hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            own = np.bincount(code, np.diff(found.rows), len(names)).astype(np.int64)
            for name, n in zip(names, own.tolist(), strict=True):
                by_lang[name] = by_lang.get(name, 0) + n
        cell = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(cell) + list(by_lang), pa.string()),
                pa.array([*cell.tolist(), *[None] * len(by_lang)], pa.int64()),
                pa.array([*mass[cell].tolist(), *by_lang.values()], pa.int64()),
            ],
            names=["lang", "cell", "n"],
        )

    rows = texts.mapInArrow(count, "lang string, cell bigint, n bigint")
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


# --- Misra-Gries summaries ------------------------------------------------------------------


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


@dataclass
class Summary:
    """Counters of at most `capacity` keys; a true count is at most its counter plus `given`."""

    capacity: int
    keys: np.ndarray
    counts: np.ndarray
    given: int = 0

    @classmethod
    def empty(cls, capacity: int) -> Summary:
        return cls(capacity, np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def merge(self, keys: np.ndarray, counts: np.ndarray, given: int = 0) -> None:
        """Add another summary's counters, or a part of the stream."""
        keys, counts = _sum(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.capacity:
            # As much as the first counter over the capacity holds, from all of them.
            out = int(-np.partition(-counts, self.capacity)[self.capacity])
            counts = counts - out
            keys, counts, given = keys[counts > 0], counts[counts > 0], given + out
        self.keys, self.counts, self.given = keys, counts, self.given + given

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(given, keys, counts) of rows of bounded size; what was given up goes with the first."""
        for lo in range(0, max(1, len(self.keys)), ROW_COUNTERS):
            part = slice(lo, lo + ROW_COUNTERS)
            yield 0 if lo else self.given, self.keys[part], self.counts[part]

    def can_reach(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.given >= threshold]


def _capacity(mass: np.ndarray | int, threshold: int):
    """More than mass / threshold: then less than `threshold` is given up of any count."""
    return SLACK * mass // threshold + 1


def _summaries(texts: DataFrame, longest: int, bits: int, mass: np.ndarray, threshold: int) -> DataFrame:
    """(cell, given, keys, counts): summaries of parts of the corpus, by hash cell."""
    shared = texts.sparkSession.sparkContext.broadcast(_capacity(mass, threshold))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capacity, held, n = shared.value, [], 0
        for found, _, _ in _read(batches, longest):
            keys, counts = np.unique(found.hashes, return_counts=True)
            held.append((keys, counts))
            n += len(keys)
            if n > HELD:
                keys, counts = _sum(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [(keys, counts)], len(keys)
                if n > HELD // 2:
                    yield summarise(keys, counts, capacity)
                    held, n = [], 0
        if n:
            yield summarise(*_sum(*(np.concatenate(x) for x in zip(*held, strict=True))), capacity)

    def summarise(keys: np.ndarray, counts: np.ndarray, capacity: np.ndarray) -> pa.RecordBatch:
        cells = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        own = []
        for a, b in zip(at, [*at[1:], len(keys)], strict=True):
            part = Summary.empty(int(capacity[cells[a]]))
            part.merge(keys[a:b], counts[a:b])
            own.extend((int(cells[a]), *row) for row in part.rows())
        cell, given, keys, counts = zip(*own, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cell, pa.int64()),
                pa.array(given, pa.int64()),
                pa.array([x.tobytes() for x in keys], pa.binary()),
                pa.array([x.astype(np.uint32).tobytes() for x in counts], pa.binary()),
            ],
            names=["cell", "given", "keys", "counts"],
        )

    return texts.mapInArrow(read, "cell bigint, given bigint, keys binary, counts binary")


def _survivors(summaries: DataFrame, bits: int, mass: np.ndarray, threshold: int, filter_bits: int) -> DataFrame:
    """(cell, bits): each cell's part of the filter, with a bit for each n-gram that can be frequent.

    A task takes the summaries of its cells one after the other, whatever their number.
    """
    shared = summaries.sparkSession.sparkContext.broadcast(_capacity(mass, threshold))
    width = filter_bits - bits  # of a cell, as a power of two

    def told(cell: int, whole: Summary) -> pa.RecordBatch:
        keys = whole.can_reach(threshold)
        at = (keys >> np.uint64(64 - filter_bits)).astype(np.int64) & ((1 << width) - 1)
        out = np.zeros(1 << width, bool)
        out[at] = True
        packed = np.packbits(out).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([packed], pa.binary())], names=["cell", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, whole, waiting, held = None, None, [], 0

        def settle() -> None:
            keys, counts, given = zip(*waiting, strict=True)
            whole.merge(np.concatenate(keys), np.concatenate(counts), sum(given))
            waiting.clear()

        for batch in batches:
            own, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                if own[k] != cell:
                    if waiting:
                        settle()
                        held = 0
                    if whole is not None:
                        yield told(cell, whole)
                    cell, whole = own[k], Summary.empty(int(shared.value[own[k]]))
                keys = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                counts = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint32).astype(np.int64)
                waiting.append((keys, counts, given[k]))
                held += len(keys)
                # Many at once, as each merge sorts all counters.
                if held > max(HELD // 16, len(whole.keys)):
                    settle()
                    held = 0
        if waiting:
            settle()
        if whole is not None:
            yield told(cell, whole)

    grouped = summaries.repartition("cell").sortWithinPartitions("cell")
    return grouped.mapInArrow(merge, "cell bigint, bits binary")


# --- exact counts ---------------------------------------------------------------------------


def _counted(texts: DataFrame, longest: int, bitmap: np.ndarray, filter_bits: int) -> DataFrame:
    """(lang, size, phrase, n): occurrences of the n-grams that pass the filter, by slice."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, code, names in _read(batches, longest):
            at = (found.hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
            kept = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if not len(kept):
                continue
            # N-grams are equal if both hashes are, 128 bits together.
            second = found.check()[kept]
            order = np.lexsort((second, found.hashes[kept]))
            key, second = found.hashes[kept][order], second[order]
            new = np.ones(len(order), bool)
            new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
            start = np.flatnonzero(new)
            one = kept[order[start]]
            row = np.searchsorted(found.rows, found.first[one], side="right") - 1
            lang = pa.array(names, pa.string()).take(pa.array(code[row].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    lang,
                    pa.array(found.size[one].astype(np.int32)),
                    found.phrases(one),
                    pa.array(np.diff(np.append(start, len(order)))),
                ],
                names=["lang", "size", "phrase", "n"],
            )

    return texts.mapInArrow(count, "lang string, size int, phrase string, n bigint")


def _cell_bits(texts: DataFrame, longest: int) -> int:
    """Hash cells, as a power of two, by the bytes of all texts."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_CELL_BITS, max(6, (longest * total // 4 // CELL_MASS).bit_length()))


def frequent_phrases(
    texts: DataFrame, longest: int, threshold: int, filter_bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """All n-grams of 1 to `longest` words that occur `threshold` times or more in their language.

    Takes (lang, text); returns (lang, size, phrase, f) and the words of each language
    (lang, n), both exact.
    """
    bits = _cell_bits(texts, longest)
    masses = staged(_masses(texts, longest, bits), "masses", BATCH_ROWS)
    mass = np.zeros(1 << bits, np.int64)
    # At most 2^MAX_CELL_BITS rows.
    held = masses.where("cell IS NOT NULL").select("cell", "n").toArrow()
    mass[held["cell"].to_numpy()] = held["n"].to_numpy()
    parts = staged(
        _survivors(_summaries(texts, longest, bits, mass, threshold), bits, mass, threshold, filter_bits),
        "survivors",
        BATCH_ROWS,
    )
    bitmap = np.zeros((1 << bits, 1 << (filter_bits - bits - 3)), np.uint8)
    told = parts.toArrow()  # as many bytes as the filter at most
    for cell, packed in zip(told["cell"].to_pylist(), told["bits"].to_pylist(), strict=True):
        bitmap[cell] = np.frombuffer(packed, np.uint8)
    counted = _counted(texts, longest, bitmap.reshape(-1), filter_bits)
    exact = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    words_of = masses.where("cell IS NULL").select("lang", "n")
    return staged(exact.where(F.col("f") >= threshold), "phrases", BATCH_ROWS), words_of


# --- scores ---------------------------------------------------------------------------------


def _span(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def _with_counts(cuts: DataFrame, phrases: DataFrame, part: str, words: Column, name: str) -> DataFrame:
    """Add the count of the phrase of `words` words in column `part`; single words are salted.

    A frequent word is part of many phrases; longer parts of far fewer.
    """
    salt = F.when(words == 1, F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS))).otherwise(0).cast("int")
    last = F.when(F.col("size") == 1, SALTS - 1).otherwise(0)
    counts = phrases.select(
        "lang", F.col("phrase").alias(part), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), last)).alias("salt")
    )
    return cuts.withColumn("salt", salt).join(counts, ["lang", part, "salt"]).drop("salt")


def collocations(
    documents: DataFrame,
    shortest: int = 2,
    longest: int = 3,
    least: int = 10,
    absorbed: int = 50,
    top: int = 2000,
    lang_column: str = "lang",
    text_column: str = "text",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Each language's first `top` phrases of `shortest` to `longest` words by their weakest cut.

    A-Z are lower-cased, pieces end at `.,;:!?` and line ends, words stand between spaces and
    tabs. A phrase that occurs a >= `least` times is cut after its first k words; l and r are the
    counts of both parts, and the cut of lowest floor(10^6 a^2 / (l r)) gives the score, the least
    k of equal ones. A phrase inside a longer one that has `absorbed` per cent of its
    occurrences or more is dropped. Returns lang, rank (from 1), phrase, a, l, r, n (words of the
    language), score, by score, then a, both descending, then phrase.

    A null language is `und`, a null text empty; repeated rows count each time; other columns are
    not read; an empty table gives no rows. Products take up to 38 digits.
    """
    texts = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    phrases, words_of = frequent_phrases(texts, longest, least, filter_bits)
    candidates = phrases.where(F.col("size") >= shortest).withColumn("words", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "size", F.col("f").alias("a"), "k",
        _span(F.lit(1), F.col("k")).alias("left"), _span(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    cuts = _with_counts(cuts, phrases, "left", F.col("k"), "l")
    cuts = _with_counts(cuts, phrases, "right", F.col("size") - F.col("k"), "r")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(
        f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST({wide('a')} * {wide('a')} AS DECIMAL(31, 0))) "
        f"DIV CAST({wide('l')} * {wide('r')} AS DECIMAL(38, 0))"
    )
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    longer = candidates.where(F.col("size") > shortest).select(
        "lang", F.col("f").alias("longer"), "words", "size",
        F.explode(F.sequence(F.lit(shortest), F.col("size") - 1)).alias("m"),
    )
    inside = longer.withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)"))).select(
        "lang", _span(F.col("at"), F.col("m")).alias("phrase"), "longer"
    )
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))
    )
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may hold most phrases: the best of each share first.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    flat = flat.withColumn("share", share)
    some = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order)))
    some = some.where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    # One row per language.
    named = ranked.where(F.col("rank") <= top).join(words_of, "lang")
    return named.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
