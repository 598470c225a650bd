"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

Texts are read as sentences of units: tokens between white space, in lower case, without marks inside
(`s-t.upid`), runs of single letters joined (`m o r o n`). Two units are compared by the
subsequences of three characters they share, each weighing `DECAY` to the power of its span, gaps
included, so an inserted character lowers the kernel but doesn't break it. Two sentences are
as similar as their most similar units; a text is as toxic as its worst sentence.

Nyström: the kernel of a unit with a bounded number of landmark units, times the inverse root of
the landmarks' own kernel matrix, is the feature vector of a linear machine. Since a kernel value is
a sum over subsequences, the trained machine folds into one weight for each subsequence of the
landmarks, a sorted array that scores any unit exactly as the kernel would.

Only texts are labelled, not sentences: every toxic text contributes its worst unit, found
with the machine of the round before, and clean texts contribute their units of highest score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged
from salesmerge.llm.token_counts import LETTER, NUMBER, SPACE, _classes
from salesmerge.llm.words import Memo, Slice, gather, kept, slices, span_hashes

DECAY, SPAN = 0.7, 4
#: Second and third character of a subsequence, counted from its first.
_STEPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
RIDGE = 3.0
#: Units of a block of the kernel matrix; bounds the driver's memory.
BLOCK = 256
#: Characters of a block of units that are scored at once, and bytes of text read at once.
CHARACTERS, SLICE = 1 << 15, 1 << 19
_CUT = re.compile(rb"[A-Za-z0-9]{2}[ \t\n\r]+(?=[A-Za-z0-9]{2})")
#: Share of the toxic learning texts that must have a candidate unit or one like it.
SUPPORT = 0.04
_BEGIN, _END = 1, 2
_SCALE, _SHIFT = 1e9, 1000.0


@dataclass
class Units:
    """Units of a slice: spans of `points` (code points); row r has units rows[r]:rows[r + 1]."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def units(piece: Slice) -> Units:
    """Read a slice as units; sentences only group them and need no record of their own."""
    raw = piece.data.tobytes()
    bounds = piece.offsets
    lowered = [raw[a:b].decode("utf-8").lower() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(text) + 1 for text in lowered])])
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    at = np.flatnonzero((kind == LETTER) | (kind == NUMBER))
    if not len(at):
        none = np.zeros(0, np.int64)
        return Units(points[:0], none, none, np.zeros(len(offsets), np.int64))
    blanks = np.cumsum(kind == SPACE)[at]
    starts = np.flatnonzero(np.diff(blanks, prepend=-1) != 0)
    single = np.diff(np.append(starts, len(at))) == 1
    row = np.searchsorted(offsets, at[starts], side="right") - 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    starts, row = starts[~joined], row[~joined]
    ends = np.append(starts[1:], len(at))
    return Units(points[at], starts, ends, np.searchsorted(row, np.arange(len(offsets))))


def _subsequences(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Unit, key and weight of all subsequences of each unit with its begin and end marks."""
    lengths = ends - starts
    padded = lengths + 2
    first = np.cumsum(padded) - padded
    text = np.empty(int(padded.sum()), np.int64)
    text[first] = _BEGIN
    text[first + padded - 1] = _END
    text[gather(first + 1, lengths)] = points[gather(starts, lengths)]
    unit = np.repeat(np.arange(len(starts)), padded)
    left = np.repeat(first + padded, padded) - np.arange(len(text))  # characters from here on
    own, keys, weights = [], [], []
    for a, b in _STEPS:
        at = np.flatnonzero(left > b)
        own.append(unit[at])
        keys.append(text[at] << 42 | text[at + a] << 21 | text[at + b])
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    return np.concatenate(own), np.concatenate(keys), np.concatenate(weights)


def _vectors(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Sparse unit vectors of length 1 in the space of subsequences: unit, key, value."""
    own, keys, weights = _subsequences(points, starts, ends)
    order = np.lexsort((keys, own))
    own, keys, weights = own[order], keys[order], weights[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    own, keys = own[at], keys[at]
    weights = np.add.reduceat(weights, at) if len(at) else weights
    length = np.sqrt(np.bincount(own, weights**2, len(starts)))
    return own, keys, weights / np.maximum(length, 1e-12)[own]


def _long_vector(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of one unit longer than a block, its subsequences added up piece by piece."""
    text = np.concatenate([[_BEGIN], unit, [_END]]).astype(np.int64)
    keys, weights = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(text), CHARACTERS):
        for a, b in _STEPS:
            at = np.arange(lo, min(lo + CHARACTERS, len(text) - b))
            found = text[at] << 42 | text[at + a] << 21 | text[at + b]
            new, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            weights = np.bincount(back, np.concatenate([weights, np.full(len(at), DECAY ** (b - 2))]), len(new))
            keys = new
    return keys, weights / max(float(np.sqrt((weights**2).sum())), 1e-12)


def _spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    return points, ends - sizes, ends


def _dense(words: list[str], columns: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of values over the columns (subsequence keys; the words' own if None) for each word."""
    own, keys, values = _vectors(*_spell(words))
    if columns is None:
        columns = np.unique(keys)
    at = np.minimum(np.searchsorted(columns, keys), max(len(columns) - 1, 0))
    hit = columns[at] == keys if len(columns) else np.zeros(len(keys), bool)
    out = np.zeros((len(words), len(columns)), np.float32)
    out[own[hit], at[hit]] = values[hit]
    return columns, out


@dataclass
class Machine:
    """Weight of each known subsequence, and the line that turns a margin into a probability."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Margin of each unit, by blocks of bounded characters."""
        out = np.full(len(starts), self.bias)
        if not len(self.keys):
            return out
        sizes = np.cumsum(ends - starts + 2)
        lo = 0
        while lo < len(starts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + CHARACTERS, side="right")))
            if sizes[lo] - before > CHARACTERS:
                keys, values = _long_vector(points[starts[lo] : ends[lo]])
                own, hi = np.zeros(len(keys), np.int64), lo + 1
            else:
                own, keys, values = _vectors(points, starts[lo:hi], ends[lo:hi])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[lo:hi] += np.bincount(own[hit], values[hit] * self.weights[at[hit]], hi - lo)
            lo = hi
        return out


def _train(words: list[str], target: np.ndarray, weight: np.ndarray, landmarks: list[str], ridge: float) -> Machine:
    """Squared-hinge machine on Nyström features, by Newton steps on its support vectors."""
    columns, table = _dense(landmarks, None)
    values, axes = np.linalg.eigh((table @ table.T).astype(np.float64))
    good = values > 1e-6
    root = axes[:, good] / np.sqrt(values[good])  # landmark kernel to features
    basis = table.T @ root.astype(np.float32)
    x = np.ones((len(words), basis.shape[1] + 1), np.float32)
    for lo in range(0, len(words), BLOCK):
        part = words[lo : lo + BLOCK]
        x[lo : lo + BLOCK, :-1] = _dense(part, columns)[1] @ basis
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        margin = target * (x @ w)
        live = margin < 1
        if not live.any():
            break
        own_x = x[live].astype(np.float64) * np.sqrt(weight[live])[:, None]
        right = own_x.T @ (np.sqrt(weight[live]) * target[live])
        new = np.linalg.solve(own_x.T @ own_x + np.diag(penalty), right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return Machine(columns, basis @ w[:-1], float(w[-1]))


def _pieces(column: pa.Array) -> Iterator[Slice]:
    """Slices of a column; a longer text comes in several, cut where no unit is torn.

    A cut lies between two words of two or more plain letters or digits each, which are never joined.
    """
    for piece in slices(column, SLICE):
        raw = piece.data.tobytes() if len(piece.data) > SLICE else b""
        lo = 0
        while len(raw) - lo > SLICE:
            cut = _CUT.search(raw, lo + SLICE // 2)
            if cut is None:
                break
            part = piece.data[lo : cut.end()]
            yield Slice(piece.first, piece.last, part, np.array([0, len(part)]))
            lo = cut.end()
        if lo:
            yield Slice(piece.first, piece.last, piece.data[lo:], np.array([0, len(raw) - lo]))
        else:
            yield piece


def _best_margins(column: pa.Array, machine: Machine, memo: Memo) -> np.ndarray:
    """The largest margin of the units of each text; NaN without units."""
    best = np.full(len(column), np.nan)
    for piece in _pieces(column):
        read = units(piece)
        if not len(read.starts):
            continue
        distinct, one, back = np.unique(
            span_hashes(read.points, read.starts, read.ends), return_index=True, return_inverse=True
        )
        known = memo.get(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            margin = machine.margins(read.points, read.starts[one[new]], read.ends[one[new]])
            known[new] = np.round((np.clip(margin, -900, 900) + _SHIFT) * _SCALE)
            memo.put(distinct[new], known[new])
        has = np.flatnonzero(np.diff(read.rows))
        value = np.maximum.reduceat(known[back], read.rows[has]) / _SCALE - _SHIFT
        best[piece.first + has] = np.fmax(best[piece.first + has], value)
    return best


def text_margins(rows: DataFrame, machine: Machine, id_column: str, text_column: str) -> DataFrame:
    """(id, margin): the largest margin of the units of each whole text; null without units."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        memo = Memo(19)
        for batch in batches:
            best = _best_margins(batch.column(1), shared.value, memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, mask=np.isnan(best))], names=["id", "margin"]
            )

    narrow = rows.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(score, f"`{id_column}` {kind}, margin double")


def _unit_rows(rows: DataFrame) -> DataFrame:
    """(id, toxic, unit): the distinct units of each learning text (id, toxic, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            for piece in slices(batch.column(2), SLICE):
                found = units(piece)
                if not len(found.starts):
                    continue
                row = np.repeat(np.arange(len(found.rows) - 1), np.diff(found.rows))
                own = span_hashes(found.points, found.starts, found.ends)
                order = np.lexsort((own, row))
                first = np.ones(len(order), bool)
                first[1:] = (row[order][1:] != row[order][:-1]) | (own[order][1:] != own[order][:-1])
                pick = np.sort(order[first])
                text = found.points.tobytes().decode("utf-32-le")
                spans = zip(found.starts[pick].tolist(), found.ends[pick].tolist(), strict=True)
                take = pa.array(piece.first + row[pick])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array([text[a:b][:200] if b - a > 200 else text[a:b] for a, b in spans]),
                    ],
                    names=["id", "toxic", "unit"],
                )

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, toxic int, unit string")


def fit(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = 8_000,
    landmarks: int = 400,
    negatives: int = 12_000,
    rounds: int = 3,
    seed: int = 7,
) -> Machine:
    """Train on documents (id, text) and labels (id, toxic), a bounded sample of them.

    `sample` bounds the learning texts of each label (those of least id hash), `landmarks` the
    kernel's landmarks, `negatives` the clean units of a round. Null labels, ids and texts teach nothing.
    Without a text of each label the machine finds everything clean.
    """
    there = documents.where("id IS NOT NULL AND text IS NOT NULL")
    # Ids are sampled before any text moves; the sample's size bounds the broadcast.
    usable = labels.where("id IS NOT NULL AND toxic IN (0, 1)").join(there.select("id"), "id", "left_semi")
    chosen = None
    for label in (0, 1):
        own = usable.where(F.col("toxic") == label).select("id", "toxic").distinct()
        own = own.orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = own if chosen is None else chosen.union(own)
    chosen = staged(chosen, "chosen")
    rows = staged(
        there.join(F.broadcast(chosen), "id").select(
            "id", F.col("toxic").cast("int").alias("toxic"), "text"
        ),
        "learning",
    )
    found = staged(_unit_rows(rows), "units")
    counts = staged(
        found.groupBy("unit").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
        ),
        "unit-counts",
    )
    texts = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    never = Machine(np.zeros(0, np.int64), np.zeros(0), -1.0, 10.0, 0.0)
    if not texts.get(0) or not texts.get(1):
        return never
    # Log odds that a text with the unit is toxic.
    odds = F.log((F.col("bad") + 0.1) / texts[1]) - F.log((F.col("good") + 0.5) / texts[0])
    rated = counts.withColumn("odds", odds * F.sqrt(F.col("bad")))
    # Candidates are far more frequent in toxic texts, and in several of them.
    telling = rated.where((F.col("bad") >= 3) & (odds >= float(np.log(8)))).select("unit", "odds")
    best = (
        found.where("toxic = 1")
        .join(telling, "unit")
        .groupBy("id")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("odds", "unit")), asc=False), 1, 12).alias("best"))
    )
    bags = [[(x["odds"], x["unit"]) for x in r["best"]] for r in staged(best, "toxic-units").collect()]
    listed = staged(counts.join(telling.select("unit"), "unit").select("unit", "bad"), "telling").collect()
    bad_texts = {r["unit"]: r["bad"] for r in listed}
    bags = _supported(bags, bad_texts, SUPPORT * texts[1]) if bags else []
    if not bags:
        return never
    # Units that reach the support alone always count, also next to worse ones.
    known = sorted(u for u, n in bad_texts.items() if n >= SUPPORT * texts[1])
    # A clean unit is at most twice as frequent in toxic texts as in clean ones.
    clean = counts.where(
        (F.col("good") > 0) & (F.col("bad") / texts[1] <= 2 * F.col("good") / texts[0])
    )
    common = clean.orderBy(F.desc("good"), "unit").limit(negatives // 2)
    spread = clean.orderBy(F.xxhash64("unit", F.lit(seed)), "unit").limit(negatives // 2)
    base = [r["unit"] for r in common.union(spread).select("unit").distinct().collect()]
    # Only candidates that stand in several toxic texts may be landmarks of the toxic side.
    support: dict[str, int] = {}
    worst = [max(bag)[1] for bag in bags]
    for unit in worst:
        support[unit] = support.get(unit, 0) + 1
    self_told = set(known)
    support |= {u: bad_texts[u] for u in known}
    marks = sorted(support, key=lambda u: (-support[u], u))[: landmarks // 2]
    order = np.random.default_rng(seed).permutation(len(base))
    marks += [base[k] for k in order[: landmarks - len(marks)]]
    hard: set[str] = set()
    machine = never
    for _ in range(rounds):
        bad = sorted({*worst, *known})
        shown = set(bad)
        good = [u for u in {*base, *hard} if u not in shown]
        good.sort()
        times = {u: 0 for u in bad}
        for unit in worst:
            times[unit] += 1
        times = {u: max(n, bad_texts[u] if u in self_told else 1) for u, n in times.items()}
        target = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
        weight = np.concatenate([[np.sqrt(times[u]) for u in bad], np.full(len(good), 1.0)])
        weight[: len(bad)] *= len(good) / max(1.0, weight[: len(bad)].sum())
        machine = _train([*bad, *good], target, weight, marks, RIDGE)
        # The worst unit of each toxic text, and the clean units it would take for toxic.
        listed = sorted({unit for bag in bags for _, unit in bag})
        margin = dict(zip(listed, machine.margins(*_spell(listed)).tolist(), strict=True))
        top_units = [max((margin[u], u) for _, u in bag) for bag in bags]
        worst = [unit for value, unit in top_units if value > 0] or worst
        scored = text_margins(clean.select("unit", F.col("unit").alias("t")), machine, "unit", "t")
        top = scored.orderBy(F.desc("margin"), "unit").limit(negatives // 6)
        hard |= {r["unit"] for r in top.collect()}
    marked = staged(text_margins(rows, machine, "id", "text"), "margins")
    pairs = marked.join(F.broadcast(chosen), "id").where("margin IS NOT NULL").select("toxic", "margin").toArrow()
    label, margin = pairs["toxic"].to_numpy().astype(float), pairs["margin"].to_numpy()
    machine.slope, machine.shift = _line(margin, label)
    return machine


def _supported(bags: list[list[tuple[float, str]]], bad: dict[str, int], least: float):
    """Bags with only the units that stand, themselves or in similar form, in `least` texts.

    A wrongly labelled text and its copies share many rare units; an insult has relatives elsewhere.
    """
    names = sorted({unit for bag in bags for _, unit in bag})
    support = np.zeros(len(names))
    counts = np.array([bad[name] for name in names], float)
    for lo in range(0, len(names), BLOCK):  # the kernel matrix, block by block
        columns, block = _dense(names[lo : lo + BLOCK], None)
        for to in range(0, len(names), BLOCK):
            other = _dense(names[to : to + BLOCK], columns)[1]
            near = np.clip(2 * (block @ other.T) - 1, 0, 1)
            support[lo : lo + BLOCK] += near @ counts[to : to + BLOCK]
    good = {name for name, n in zip(names, support, strict=True) if n >= least}
    kept = [[(odds, unit) for odds, unit in bag if unit in good] for bag in bags]
    return [bag for bag in kept if bag]


def _line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic calibration, the slope bounded."""
    if not len(label) or label.min() == label.max():
        return 4.0, 0.0
    weight = np.ones(len(label))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + 1e-3 * len(label) * w * [1, 0] * 0.01
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-5 * len(label)
        w = w - np.linalg.solve(curve, gradient)
        w[0] = np.clip(w[0], 0.5, 30.0)
    return float(w[0]), float(w[1])


def toxicity(
    documents: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`id_column`, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5).

    A null text, and one without letters or digits, has score 0. One row in, one row out; no other
    column is read.
    """
    margin = text_margins(documents, machine, id_column, text_column)
    probability = 1 / (1 + F.exp(-(F.col("margin") * machine.slope + machine.shift)))
    return margin.select(id_column, F.coalesce(probability, F.lit(0.0)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def clean_documents(documents: DataFrame, machine: Machine, text_column: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text isn't toxic; they are scored where they are read.

    Null texts and texts without letters or digits stay. No key, no join and no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    place, names = documents.columns.index(text_column), documents.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        own, memo = shared.value, Memo(19)
        for batch in batches:
            margin = _best_margins(batch.column(place), own, memo)
            # A score below 0.5; NaN, which has none, stays.
            yield batch.filter(pa.array(~(margin * own.slope + own.shift >= 0))).rename_columns(names)

    return documents.mapInArrow(keep, documents.schema)
