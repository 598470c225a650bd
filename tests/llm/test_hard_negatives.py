"""Hard negatives against a plain search, and exact scores against big integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmerge.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


def _rows(n=700, dimension=12, seed=1):
    random = np.random.default_rng(seed)
    vectors = random.normal(size=(n, dimension)).astype(np.float32)
    vectors[n // 7 : n // 2] = vectors[0]  # a third of all rows are copies
    rows = [(k, vectors[k].tolist(), int(random.integers(0, 4)), "clash") for k in range(n)]
    return rows + [
        (50, vectors[3].tolist(), 2, "repeated id"), (None, vectors[0].tolist(), 1, ""), (900, None, 1, ""),
        (901, vectors[0].tolist(), None, ""), (902, [float("nan")] * dimension, 1, ""), (903, [None] * dimension, 1, ""),
        (904, [float("-inf")] * dimension, 2, ""), (905, [], 3, ""), (906, vectors[0][:5].tolist(), 3, ""),
    ]


def _plain(rows, every=50):
    usable = []
    for place, (id_, vector, label, _) in enumerate(rows):
        if id_ is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((id_, place, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    out = []
    for a in (x for x in usable if x[0] % every == 0):
        rated = sorted((-score(a, b), b[0], b[1], b[2]) for b in usable if b is not a)
        for p in [x for x in rated if x[3] == a[2]][:5]:
            own = [x for x in rated if x[3] != a[2] and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:10]
            out += [(a[0], p[1], k + 1, x[1], -p[0], -x[0]) for k, x in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("panel", [hn.PANEL, 4])
def test_equals_a_plain_search(spark, panel):
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hn.hard_negatives(frame, F.col("vec_id") % 50 == 0, F.col("label"), panel=panel).collect()
    assert sorted(map(tuple, got)) == _plain(rows)


def test_blocks_and_wide_scores(spark, monkeypatch):
    monkeypatch.setattr(hn, "_NARROW", 1)  # ties are then broken by a stable sort
    rows = _rows(300, seed=4)
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    best = hn._Best(1, 3)
    for lo in (0, 4):
        scores = np.array([[5, 9, 9, 7]])
        best.add(np.array([0]), scores, np.ones((1, 4), bool), np.arange(lo, lo + 4), np.arange(lo, lo + 4))
    assert best.score.tolist() == [[9, 9, 9]] and best.id.tolist() == [[1, 2, 5]]
    monkeypatch.undo()
    monkeypatch.setattr(hn, "ROWS", 7)
    got = hn.hard_negatives(frame, F.col("vec_id") % 50 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == _plain(rows)


def test_no_rows_and_no_anchors(spark):
    frame = spark.createDataFrame(_rows(30), SCHEMA)
    for rows in (frame.limit(0), frame.where("vec_id = 7")):
        found = hn.hard_negatives(rows, F.col("vec_id") % 50 == 0, F.col("label"))
        assert found.count() == 0 and "negative_score" in found.columns


@pytest.mark.parametrize("dimension", [1, 3, 64, 300, 1500])
def test_residues_give_exact_scores(dimension):
    random = np.random.default_rng(dimension)
    for size in (3, 2**12, 2**20, 2**25):
        a = random.integers(-size, size + 1, (6, dimension))
        b = random.integers(-size, size + 1, (9, dimension))
        a[0], b[0] = size, -size  # the extreme score
        largest = int(max((x.astype(object) ** 2).sum() for x in [*a, *b]))
        if largest >= 2**61:
            continue
        moduli = hn.primes(dimension, largest)
        assert np.prod([int(p) for p in moduli], dtype=object) > 2 * largest
        found = hn.Residues.of(a, moduli).scores(hn.Residues.of(b, moduli))
        assert (found.astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_scores_beyond_63_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e9, 1e9], 1, ""), (1, [1e9, 1.0], 1, "")], SCHEMA)
    with pytest.raises(ValueError, match="63 bits"):
        hn.hard_negatives(frame, F.col("vec_id") == 0, F.col("label"))
