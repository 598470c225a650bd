"""The pipeline over a small corpus with planted cases."""

import hashlib
import random

import pytest

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, prose(rng, 80)) for k in range(200)]
    toxic = set(range(0, 40))
    rows = [(k, f"{t} zorbag {prose(rng, 3)}" if k in toxic else t) for k, t in rows]
    item, passage, body = prose(rng, 30), prose(rng, 60), prose(rng, 120)
    rows += [(300, body), (301, body), (302, f"{body} end")]
    rows += [(310, f"{prose(rng, 40)} {passage}"), (311, f"{passage} {prose(rng, 40)}")]
    rows += [(320, f"{prose(rng, 50)} {item} {prose(rng, 50)}"), (330, None), (331, ""), (200, rows[150][1])]
    rows += [rows[160]]
    spark.createDataFrame(
        [(k, t, "en", "s", len(t or "")) for k, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k in toxic)) for k in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {k: t for k, t in rows}, toxic


def test_stages(spark, corpus):
    folder, texts, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    left = {r.doc_id for r in clean.collect()}
    assert not left & toxic and len(set(texts) - toxic - left) <= 3  # trained on 200 short texts
    once = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(texts) - {200, 301, 302})
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, once, folder).collect()}
    assert all(cut[k].text == texts[k] for k in cut if k not in (310, 311))
    assert [len(cut[k].text.split()) for k in (310, 311)] == [40, 40]
    assert cut[310].n_chars == len(cut[310].text)
    free = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert set(texts) - {r.doc_id for r in free.collect()} == {320}
    assert free.columns == cut[310].__fields__ == docs.columns


def test_run(spark, corpus):
    folder, texts, toxic = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    expected = set(texts) - toxic - {200, 301, 302, 320}
    assert set(got) <= expected and len(expected - set(got)) <= 3
    for k in set(got) - {310, 311}:
        assert got[k].decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest()
        assert len(got[k].ids) == got[k].n_tokens
