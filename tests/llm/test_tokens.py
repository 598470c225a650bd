"""Token counts and byte-level BPE against the public libraries, on awkward texts."""

import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from salesmerge.llm import byte_bpe, token_counts
from salesmerge.llm.words import kept, slices

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", None, "it's 's 'sun ''s a's's  \n\n x", "  lead", "trail  ", "a\n 's", "\t'll !'re don't", "'", "x'",
    "x<|endoftext|> y <|endoftext|>", "aaaaaaaaaa" * 120, " " * 300 + "x", "日本語テキスト ñé 12345 ½Ⅷ",
    "\x85b\x1cc", "ab" * 700 + "aaa", "qzjxkv" * 500, "𝔘𝔫𝔦 🙂🙂", "long " * 3000,
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, text, "clash") for k, text in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "null id", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_counts_equal_the_library(documents):
    library = Tokenizer.from_file(JSON)
    got = token_counts.token_counts(documents, JSON).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = "null id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(text.encode()), n > 1024)


def test_chunks_compose(monkeypatch):
    whole = [token_counts.count_slice(s, JSON).tolist() for s in slices(pa.array(TEXTS))]
    monkeypatch.setattr(token_counts, "LANES", 1 << 20)  # so that chunks are shorter than words
    token_counts.machine(JSON)[2].keys[:] = 0
    token_counts.machine(JSON)[2].values[:] = -1
    assert [token_counts.count_slice(s, JSON).tolist() for s in slices(pa.array(TEXTS))] == whole


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert token_counts.token_counts(none, JSON).count() == 0
    assert byte_bpe.round_trip(none, RANKS).count() == 0


def test_encoding_equals_the_library_and_decodes(documents):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    encoded = byte_bpe.encode(documents, RANKS)
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect()}
    digests = {r.doc_id: r for r in byte_bpe.round_trip(documents, RANKS, with_ids=True).collect()}
    for row in encoded.collect():
        text = "null id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        own = digests[row.doc_id]
        assert row.ids == ids == own.ids and decoded[row.doc_id] == text.encode()
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_worker_drops_the_codec_when_another_operator_takes_up():
    codec = byte_bpe._codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert byte_bpe._codec(public_tokenizers.path("byte_bpe_50k.tiktoken")) is codec
    codec.encode([b"contraction"])
    kept("toxicity")
    assert not kept("byte_bpe") and not codec.known
    with pytest.raises(Exception, match="closed"):
        codec.db.execute("SELECT 1")
