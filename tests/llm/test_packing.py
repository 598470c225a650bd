"""Packing against the tokenizer library, an exhaustive packing and its own bounds."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesmerge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "a", "It's DON'T  we'll", "x<|endoftext|>y <|startoftext|> <|", "é Ångström İ ΣΣ",
    "tab\tline\nform\x0cnbsp wide　sep ", "\x1cfs \x85nel", "\U0001d518\U0001d52b \U0001f642", "qz" * 900,
    "word " * 400, "1234.5,6 -- ...", "日本語 テキスト",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, text, "clash") for k, text in enumerate(TEXTS)] + [(2, "a", "again"), (None, "b", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string")


def _library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_are_the_library_s_ids(documents):
    got = packing.pack(documents, PATH, limit=50, with_ids=True, group=4).collect()
    by_doc = {}
    for row in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.piece)):
        assert row.length == len(row.ids) <= 50 and row.start == 50 * row.piece
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        by_doc.setdefault(row.doc_id, []).append(row.ids)
    for doc, text in [*enumerate(TEXTS), (None, "b")]:
        ids = _library(text)
        if doc == 2:  # stands twice
            assert by_doc[2] == [ids, ids]
            continue
        assert list(itertools.chain(*by_doc[doc])) == ids
        assert [len(x) for x in by_doc[doc][:-1]] == [50] * (len(by_doc[doc]) - 1)


def test_sequences_have_no_gaps(documents):
    packed = packing.pack(documents, PATH, limit=50, with_ids=True, group=4).cache()
    pieces = {}
    for row in packed.collect():
        pieces.setdefault(row.sequence_id, []).append((row.offset, row.ids))
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for key, own in pieces.items():
        at, ids = 0, []
        for offset, part in sorted(own):
            assert offset == at
            at, ids = at + len(part), ids + part
        assert at <= 50 and joined[key] == ids
    packed.unpersist()


def test_no_documents(documents):
    assert packing.pack(documents.limit(0), PATH).count() == 0


def _fewest(lengths, limit):
    """Fewest sequences, by trying every place for every piece."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= lengths[k]:
                put(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        put(k + 1, [*rooms, limit - lengths[k]])

    put(0, [])
    return best[0]


def test_bounds_hold_and_best_fit_is_near_them():
    random, tight = np.random.default_rng(5), 0
    for _ in range(150):
        limit = int(random.integers(4, 40))
        lengths = np.sort(random.integers(1, limit + 1, random.integers(1, 9)))[::-1]
        counts = np.bincount(lengths, minlength=limit + 1)
        bound = packing.best_bound(counts).sequences(counts)
        fewest = _fewest(lengths.tolist(), limit)
        sequence, offset = packing.best_fit(lengths, limit)
        n = int(sequence.max()) + 1
        assert bound <= fewest <= n <= fewest + 1
        tight += bound == n
        for k in range(n):
            own = sequence == k
            assert offset[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
            assert lengths[own].sum() <= limit
    assert tight > 130


def test_no_set_that_fits_weighs_more_than_one():
    for limit in (7, 12):
        for counts in np.random.default_rng(2).integers(0, 5, (40, limit + 1)):
            counts[0] = 0
            bound = packing.best_bound(counts)
            heaviest = [0] * (limit + 1)
            for room in range(1, limit + 1):
                heaviest[room] = max([heaviest[room - 1], *[heaviest[room - x] + int(bound.weights[x]) for x in range(1, room + 1)]])
            assert heaviest[limit] <= bound.full


def test_exchange_closes_the_gaps_of_the_partitions(spark):
    lengths = np.random.default_rng(3).integers(1, 1000, 6000)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "key bigint, length bigint")
    placed, bound, sequences = packing.place(rows, 1000, group=300)
    found = placed.join(rows, "key").groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(
        F.count("*"), F.max("n"), F.sum("n")
    ).first()
    assert found[0] == sequences and found[1] <= 1000 and found[2] == lengths.sum()
    by_size = -(-int(lengths.sum()) // 1000)
    assert by_size <= bound <= sequences <= bound * 1.01


def test_pieces_that_can_t_share_are_certified(spark):
    rows = spark.createDataFrame([(k, 60) for k in range(500)], "key bigint, length bigint")
    _, bound, sequences = packing.place(rows, 100, group=50)
    assert bound == sequences == 500
