"""Repeats, near-duplicates and benchmark passages against brute force."""

import random
import re
from collections import Counter

import pytest

from salesmerge.llm import minhash_dedup, substring_dedup
from salesmerge.llm.decontamination import contamination
from salesmerge.llm.minhash_dedup import near_duplicates
from salesmerge.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string, n_words string, kept string, items int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, other = prose(rng, 60), prose(rng, 35)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(30)]
    out += [f"{prose(rng, 20)}\n{passage} {prose(rng, 9)}" for _ in range(8)]
    out += [f"{other}\t{prose(rng, 50)}  {other}", prose(rng, 34), prose(rng, 35)]
    copied = prose(rng, 200).split(" ")
    out += [" ".join(copied)] * 3
    for k in range(12):  # copies with one to three words changed
        changed = list(copied)
        for _ in range(1 + k % 3):
            changed[rng.randrange(200)] = f"new{k}"
        out.append(" ".join(changed))
    out += ["same words " * 60, "", None, " \t\n", "one", "one", passage, "x" * 30_000]
    return [(k, text, "c", "c", 1) for k, text in enumerate(out)]


def repeated(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [3, 5000])
def test_repeats_equal_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    twice = [*rows, rows[2], (None, rows[5][1], "c", "c", 1)]  # a repeated row and a null id
    expected = Counter(zip([r[0] for r in twice], repeated(twice, 35), strict=True))
    cut = remove_repeats(spark.createDataFrame(twice, SCHEMA))
    assert cut.columns == ["doc_id", "text", "items", "n_words", "n_removed", "kept"]
    got = Counter((r.doc_id, (r.n_words, r.n_removed, r.kept)) for r in cut.collect())
    assert got == expected


def bags(rows):
    out = {}
    for k, text, *_ in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if words:
            out[k] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return out


def test_near_duplicates_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    own = bags(rows)
    group = {r[0]: r[0] for r in rows}
    for a in own:
        for b in own:
            if a < b and sum((own[a] & own[b]).values()) >= 0.8 * sum((own[a] | own[b]).values()):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.group_id for k, r in got.items()} == group
    assert all(r.kept == (k == r.group_id) for k, r in got.items())


def test_near_duplicates_of_odd_rows(spark, rows):
    odd = [(None, "a b c d e f", "", "", 1), (7, "a b c d e f", "", "", 1), (7, "a b c d e f", "", "", 1)]
    got = near_duplicates(spark.createDataFrame(odd, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.group_id) for r in got) == [(0, 7), (7, 7), (7, 7)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_benchmark_passages(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate((60, 25, 5, 4, 40))] + [(9, None), (4, prose(rng, 30))]
    text = {k: t for k, t in items}
    edited = items[0][1].split(" ")
    edited[0] = "other"  # one word at an edge: 55 of 57 shingles stay
    broken = items[0][1].split(" ")
    broken[::6] = ["other"] * len(broken[::6])  # no shingle stays
    documents = [
        (1, f"{prose(rng, 50)} {items[0][1]} {prose(rng, 50)}", "", "", 5),
        (2, f"{prose(rng, 9)}, {' '.join(edited).upper()}!", "", "", 5),
        (3, " ".join(broken), "", "", 5),
        (4, items[1][1], "", "", 5),
        (5, f"x {text[2]} y {text[3]} z", "", "", 5),  # items of five and of four words
        (6, None, "", "", 5),
        (7, "", "", "", 5),
        (8, prose(rng, 500), "", "", 5),
        (8, prose(rng, 500), "", "", 5),
        (None, f"{items[4][1]} {items[1][1]}", "", "", 5),
    ]
    frame = spark.createDataFrame(documents, SCHEMA)
    found = contamination(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    got = [(r.doc_id, r.contaminated, r["items"]) for r in found.collect()]
    assert len(got) == len(documents)
    assert {(k, tuple(i)) for k, c, i in got if c} == {(1, (0,)), (2, (0,)), (4, (1,)), (5, (2,)), (None, (1, 4))}
    assert found.columns == ["doc_id", "text", "n_words", "kept", "contaminated", "items", "similarity"]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(frame, none).filter("contaminated").count() == 0
    assert contamination(frame.limit(0), none).count() == 0


def test_benchmark_passage_with_parts_moved(spark):
    rng = random.Random(12)
    words = [prose(rng, 1) + str(k) for k in range(80)]
    item, swapped = " ".join(words), " ".join(words[40:] + words[:40])
    third = " ".join(words[60:] + words[:60])
    texts = [f"{prose(rng, 50)} {swapped} {prose(rng, 70)}", third, f"{prose(rng, 9)} {item}", prose(rng, 200)]
    texts += [" ".join(words[k] for k in range(79, -1, -1)), f"{swapped} {swapped}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r.similarity) for r in contamination(frame, items).collect()}

    def best(text):
        parts = text.split(" ")
        a = Counter(tuple(words[i : i + 5]) for i in range(76))
        windows = [parts[s : s + 80] for s in range(max(1, len(parts) - 79))]
        found = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in windows]
        value = max((a & b).total() / (a | b).total() for b in found)
        return (True, value) if value >= 0.8 else (False, 0.0)

    assert got == {k: pytest.approx(best(text)) for k, text in enumerate(texts)}
    assert [k for k, (yes, _) in got.items() if yes] and got[0][0] and not got[4][0]
