"""Trained operators: held-out accuracy on invented words, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesmerge.llm import language_id, quality, toxicity
from salesmerge.llm.words import slices

SYLLABLES = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "en", "tz", "er"], "cc": ["ó", "ñe", "ci", "que"]}
INSULTS = ["zorbag", "plivnik", "drumox"]


def text(rng, lang, n):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = text(rng, lang, rng.randint(5, 60)).split(" ")
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        good = int(rng.random() < 0.7)
        rows.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), lang, toxic, good))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int, quality int").cache()


ODD = [(900, None), (901, ""), (902, "12 ... !"), (902, "12 ... !"), (None, "ka lo mi")]


def test_language(spark, documents):
    model = language_id.fit(documents, F.col("doc_id") % 4 != 2)
    assert model.languages == ["aa", "bb", "cc"]
    told = language_id.predict(documents, model).join(documents, "doc_id")
    assert told.where("doc_id % 4 = 2 AND lang <> lang_pred").count() == 0
    odd = language_id.predict(spark.createDataFrame(ODD, "doc_id bigint, text string"), model, reject=False)
    assert [(r.lang_pred, r.score) for r in odd.collect()][:4] == [("und", 0.0)] * 4
    strange = spark.createDataFrame([(1, "ばびぶべぼ ざじずぜぞ")], "doc_id bigint, text string")
    assert language_id.predict(strange, model).first().lang_pred == "und"
    assert language_id.predict(strange, model, reject=False).first().lang_pred in model.languages
    empty = language_id.fit(documents.limit(0), F.lit(True))
    assert language_id.predict(strange, empty).first().lang_pred == "und"


def test_probabilities_sum_to_one(documents):
    model = language_id.fit(documents, F.lit(True), order=3)
    letters = sorted({c for s in SYLLABLES.values() for x in s for c in x} | set("".join(INSULTS).lower()) | {" "})
    grams = np.array([[ord("k"), ord("a"), ord(c)] for c in letters], np.uint32)
    total = np.exp(model.score(grams)).sum(0)
    assert (total > 0.97).all() and (total < 1.03).all()


def test_toxicity(spark, documents):
    learning = documents.select(F.col("doc_id").alias("id"), "text")
    labels = documents.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), "toxic")
    machine = toxicity.fit(learning, labels)
    told = toxicity.toxicity(documents, machine).join(documents, "doc_id").where("doc_id % 5 = 0")
    assert told.where("predicted <> toxic").count() == 0
    texts = ["ka lo z-o-r-b-a-g mi", "ka d r u m o x", "ra zorbbag lo", "ka lo mi", "Plivnik!"]
    odd = spark.createDataFrame([*enumerate(texts), *ODD], "doc_id bigint, text string")
    got = [r.predicted for r in toxicity.toxicity(odd, machine).collect()]
    assert got[:5] == [1, 1, 1, 0, 1] and got[5:9] == [0, 0, 0, 0]
    never = toxicity.fit(learning, labels.where("toxic = 0"))
    assert toxicity.toxicity(odd, never).where("predicted = 1").count() == 0


def test_kernel_equals_its_definition():
    words = ["abcab", "axbc"]
    own, keys, values = toxicity._vectors(*toxicity._spell(words))

    def direct(word):
        marked, out = "\1" + word + "\2", {}
        for i in range(len(marked)):
            for j in range(i + 1, len(marked)):
                for k in range(j + 1, min(len(marked), i + toxicity.SPAN + 1)):
                    u = (marked[i], marked[j], marked[k])
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        length = sum(v * v for v in out.values()) ** 0.5
        return {u: v / length for u, v in out.items()}

    a, b = map(direct, words)
    kernel = sum(v * b.get(u, 0) for u, v in a.items())
    first = dict(zip(keys[own == 0], values[own == 0], strict=True))
    second = dict(zip(keys[own == 1], values[own == 1], strict=True))
    assert kernel == pytest.approx(sum(v * second.get(k, 0) for k, v in first.items()))


def test_quality(spark, documents):
    labels = documents.select(F.col("doc_id").alias("id"), "quality")
    ratio = quality.fit(documents.select(F.col("doc_id").alias("id"), "text"), labels, F.col("id") % 5 != 0)
    told = quality.classify(documents, ratio).join(documents.select("doc_id", "quality"), "doc_id")
    assert told.where("doc_id % 5 = 0 AND predicted <> quality").count() == 0
    assert told.where("selected").count() == 300
    odd = quality.classify(spark.createDataFrame(ODD, "doc_id bigint, text string"), ratio)
    assert odd.count() == 5 and odd.where("selected").count() == 2
    assert quality.classify(documents.limit(0), ratio).count() == 0


def test_gumbel_top_is_exact(spark):
    rows = [(k, float(k % 7)) for k in range(500)] + [(k, 3.0) for k in range(500, 520)]
    weights = spark.createDataFrame(rows, "id bigint, log_weight double")
    for k in (1, 17, 499, 520, 600):
        got = quality.gumbel_top(weights, k).where("selected")
        assert got.count() == min(k, 520)
    noisy = quality.gumbel_top(weights, 100).toPandas()
    assert noisy[noisy.selected].noisy.min() >= noisy[~noisy.selected].noisy.max()


def test_units_join_what_marks_split():
    (piece,) = slices(pa.array(["s-t.upid A b c, word", None, "x"]))
    read = toxicity.units(piece)
    shown = read.points.tobytes().decode("utf-32-le")
    assert [shown[a:b] for a, b in zip(read.starts, read.ends, strict=True)] == ["stupid", "abc", "word", "x"]
    assert read.rows.tolist() == [0, 3, 3, 4]


def test_more_than_32_languages_are_kept_apart(spark):
    """All have the same words, and each one of its own; their counts don't mix."""
    own = [2 * (chr(97 + k // 100) + chr(107 + k // 10 % 10) + chr(97 + k % 10)) for k in range(300)]
    rows = [(k, f"common words here {own[k]} {own[k]}", f"l{k:03d}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    counted = language_id.count_grams(frame, "text", "lang", 5)
    assert counted.groupBy("lang").agg(F.sum("n").alias("n")).select("n").distinct().count() == 1
    assert counted.where("gram = 'ommon'").select("lang").distinct().count() == 300
    asked = spark.createDataFrame([(k, f"{own[k]} words") for k in range(0, 300, 3)], "doc_id bigint, text string")
    told = language_id.predict(asked, language_id.fit(frame, F.lit(True)), reject=False).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in told) >= 95


def test_a_language_whose_ngrams_are_cut_is_still_told(spark):
    rows = [(k, "often the same words again", "aa") for k in range(50)] + [(99, "zyxwv", "zz")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(frame, F.lit(True), max_grams=10)
    assert model.languages == ["aa", "zz"]
    assert language_id.predict(frame, model, reject=False).where("doc_id = 0").first().lang_pred == "aa"


def test_no_ngram_is_left_out_of_a_model_in_tables(spark, documents, monkeypatch):
    """Beyond `max_grams` the model, its limits and every prediction are those of all n-grams."""
    monkeypatch.setattr(language_id, "HEAD", 60)  # most words meet their scores in the join
    learn = F.col("doc_id") % 4 != 2
    whole = language_id.fit(documents, learn)
    tables = language_id.fit(documents, learn, max_grams=10)
    assert tables.temperature == whole.temperature
    assert np.allclose(tables.limits, whole.limits, atol=1e-4)
    odd = spark.createDataFrame([*ODD, (903, "ばび ka"), (903, "ばび ka")], "doc_id bigint, text string")
    asked = documents.select("doc_id", "text").union(odd)
    for reject in (True, False):
        told = [language_id.predict(asked, m, reject).collect() for m in (whole, tables)]
        a, b = (sorted(x, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang_pred)) for x in told)
        assert [r[:2] for r in a] == [r[:2] for r in b] and [r.rejected for r in a] == [r.rejected for r in b]
        for x, y in zip(a, b, strict=True):
            assert abs(x.score - y.score) < 1e-3
            assert (x.cross_entropy is None) == (y.cross_entropy is None)
            assert x.cross_entropy is None or abs(x.cross_entropy - y.cross_entropy) < 1e-4


def test_limits_and_temperature_come_from_all_learning_rows(spark):
    """Rows past the first thousand ids by hash are labelled amiss, and ids repeat or are null."""
    rng = random.Random(11)
    ids = [r.id for r in spark.range(1300).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(k, text(rng, "aa" if n < 1000 else "bb", rng.randint(1, 9)), "aa") for n, k in enumerate(ids)]
    rows += [(k % 40, text(rng, "bb", rng.randint(1, 9)), "bb") for k in range(1200)]
    rows += [(None, text(rng, "cc", 5), "cc") for _ in range(20)] + [(7, "12 ...", "aa"), (7, None, "aa")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for model in (language_id.fit(frame, F.lit(True)), language_id.fit(frame, F.lit(True), max_grams=10)):
        assert model.languages == ["aa", "bb", "cc"]
        told = language_id.cross_entropies(frame, model, "lang", "text").where("places > 0").collect()
        assert len(told) == 2520
        truth = np.array([model.languages.index(r.lang) for r in told])
        rates = np.array([r.entropies for r in told])
        own = rates[np.arange(len(told)), truth]
        limits = [own[truth == k].mean() + 4 * own[truth == k].std() + 0.5 for k in range(3)]
        assert model.limits.tolist() == pytest.approx(limits, rel=1e-9)
        losses = {}
        for t in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            weights = np.exp(t * (rates.min(1, keepdims=True) - rates))
            shares = weights[np.arange(len(told)), truth] / weights.sum(1)
            losses[t] = -np.log(np.maximum(shares, 1e-9)).mean()
        assert model.temperature == min(losses, key=losses.get)


def test_units_of_long_texts_are_scored_in_blocks(monkeypatch):
    """Texts and units of any length score as they do whole."""
    random = np.random.default_rng(0)
    words = ["".join(random.choice(list("abcdefghij-."), random.integers(1, 9))) for _ in range(300)]
    text = " ".join(random.choice(words, 5000))
    machine = toxicity.Machine(np.unique(toxicity._vectors(*toxicity._spell(words[:50]))[1]), np.zeros(0), -0.1)
    machine.weights = random.normal(size=len(machine.keys))
    column = pa.array([text, None, "", "a b c d " * 10, "x" * 5000, text[:300]])
    monkeypatch.setattr(toxicity, "SLICE", 1 << 30)
    monkeypatch.setattr(toxicity, "CHARACTERS", 1 << 30)
    whole = toxicity._best_margins(column, machine, toxicity.Memo(12))
    monkeypatch.setattr(toxicity, "SLICE", 1000)
    monkeypatch.setattr(toxicity, "CHARACTERS", 64)
    blocks = toxicity._best_margins(column, machine, toxicity.Memo(12))
    assert np.allclose(whole, blocks, equal_nan=True) and np.isnan(whole[1]) and np.isnan(whole[2])


def test_clean_documents_keep_their_rows(spark):
    machine = toxicity.Machine(*toxicity._vectors(*toxicity._spell(["zorbag"]))[1:], bias=-0.8, slope=4.0)
    order = np.argsort(machine.keys)
    machine.keys, machine.weights = machine.keys[order], machine.weights[order]
    rows = [(1, "you z-orbag there", "a", 1.5), (2, "fine words", None, 2.5), (None, None, "x", None), (2, "", "y", 0.0), (1, "zorbag", "b", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, margin string, score double")
    kept = toxicity.clean_documents(frame, machine)
    assert kept.schema == frame.schema
    scored = {r.doc_id for r in toxicity.toxicity(frame, machine).where("predicted = 1").collect()}
    assert scored == {1}
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([r for r in rows if r[0] != 1], key=repr)
