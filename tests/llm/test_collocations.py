"""Collocations against a plain count, and summaries against their guarantee."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from salesmerge.llm import collocations as co
from salesmerge.llm.rows import staged
from salesmerge.llm.words import slices

SCHEMA = "doc_id bigint, text string, lang string, phrase string"


def _texts(seed=3, n=160):
    random = np.random.default_rng(seed)
    words = [*"aa bb cc dd ee ff gg hh", "École", "straße", "日本", "x-y", "it's"]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        picked = random.choice(words, random.integers(0, 80), p=weight / weight.sum())
        joins = random.choice([" ", "  ", "\t", ". ", ",", "\n", "; ", "!", "\r\n", " "], len(picked), p=[0.6, *[0.4 / 9] * 9])
        text = "".join(a + b for a, b in zip(picked, joins, strict=True))
        rows.append((k, text, [None, "en", "de", "und"][k % 4], "clash"))
    rows += [(None, "New York City. " * 30, "en", ""), (7, "new YORK city, new york, York", "en", "")] * 2
    rows += [(8, None, "en", ""), (9, "", None, ""), (10, "., ;\n", "xx", ""), (11, "solo", "yy", "")]
    return rows


def _plain(rows, least=10, absorbed=50, top=2000, longest=3, shortest=2):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = {}, Counter()
    for _, text, lang, _ in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if shortest <= len(p) and a >= least}
        lost = set()
        for p, a in candidates.items():
            for size in range(shortest, len(p)):
                for i in range(len(p) - size + 1):
                    inner = p[i : i + size]
                    if 100 * a >= absorbed * candidates[inner]:
                        lost.add(inner)
        rated = []
        for p, a in candidates.items():
            if p in lost:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def test_equals_a_plain_count(spark):
    rows = _texts()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, co.collocations(frame).collect()))
    assert got == _plain(rows) and len(got) > 50
    short = sorted(map(tuple, co.collocations(frame, least=4, absorbed=80, top=5, longest=4).collect()))
    assert short == _plain(rows, 4, 80, 5, 4)


def test_a_full_filter_and_small_summaries_change_nothing(spark, monkeypatch):
    rows = _texts(seed=9)
    monkeypatch.setattr(co, "SLACK", 1)
    monkeypatch.setattr(co, "HELD", 500)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, co.collocations(frame, filter_bits=9).collect())) == _plain(rows)


def test_no_documents(spark):
    frame = spark.createDataFrame(_texts(), SCHEMA)
    assert co.collocations(frame.limit(0)).count() == 0
    assert co.collocations(frame.where("text IS NULL OR text = ''")).count() == 0


def test_large_counts_stay_exact(spark, monkeypatch):
    big = 3_000_000_019
    phrases = spark.createDataFrame(
        [("en", 1, "a", 2 * big), ("en", 1, "b", 3 * big), ("en", 2, "a b", big)],
        "lang string, size int, phrase string, f bigint",
    )
    words_of = spark.createDataFrame([("en", 5 * big)], "lang string, n bigint")
    monkeypatch.setattr(co, "frequent_phrases", lambda *_: (phrases, words_of))
    (row,) = co.collocations(spark.createDataFrame(_texts(), SCHEMA)).collect()
    assert (row.score, row.a, row.l, row.r) == (10**6 * big * big // (6 * big * big), big, 2 * big, 3 * big)


@pytest.mark.parametrize("threshold", [3, 10])
def test_every_frequent_key_survives_merging(threshold):
    random = np.random.default_rng(threshold)
    for _ in range(40):
        stream = (random.zipf(1.3, 3000) % 900).astype(np.uint64)
        capacity = len(stream) // threshold + 1
        parts = np.array_split(stream, random.integers(1, 9))
        summaries = []
        for part in parts:
            own = co.Summary.empty(capacity)
            for piece in np.array_split(part, 3):
                own.merge(*np.unique(piece, return_counts=True))
            summaries.append(own)
        whole = summaries[0]
        for other in summaries[1:]:
            whole.merge(other.keys, other.counts, other.given)
        keys, counts = np.unique(stream, return_counts=True)
        assert whole.given < threshold and len(whole.keys) <= capacity
        assert set(keys[counts >= threshold]) <= set(whole.can_reach(threshold))
        held = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
        true = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert all(n <= true[k] <= n + whole.given for k, n in held.items())


def test_equal_phrases_have_equal_second_hashes():
    (piece,) = slices(pa.array(["A b  c a\tb", "zz. a B", "b a"]))
    found = co.ngrams(piece, 2, np.zeros(3, np.uint64))
    text = found.phrases(np.arange(len(found.first))).to_pylist()
    second = found.check().tolist()
    assert len(set(zip(text, second, strict=True))) == len(set(text)) == len(set(second))
    assert sorted(text) == sorted(["a", "b", "c", "a", "b", "a b", "b c", "c a", "a b", "zz", "a", "b", "a b", "b", "a", "b a"])


def test_summaries_leave_a_task_in_rows_of_bounded_size():
    # One cell with 5,000 counters: rows of 1,024 at most, whose merge is the summary itself.
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 2**63, 6000).astype(np.uint64))
    whole = co.Summary.empty(5000)
    whole.merge(keys, rng.integers(1, 50, len(keys)))
    again = co.Summary.empty(5000)
    rows = list(whole.rows())
    assert len(rows) > 4 and max(len(k) for _, k, _ in rows) <= co.ROW_COUNTERS
    for given, part, counts in rows:
        again.merge(part, counts, given)
    assert again.given == whole.given > 0
    assert (again.keys == whole.keys).all() and (again.counts == whole.counts).all()


def test_staging_in_small_batches_leaves_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    told = staged(spark.range(5000).mapInArrow(sizes, "n long"), "sizes", 512).toPandas()["n"]
    assert told.sum() == 5000 and told.max() <= 512
    assert spark.conf.get(name) == before
