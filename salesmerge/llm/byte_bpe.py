"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A task lists the distinct words of a slice of texts. Those the worker hasn't met go to an
in-process DuckDB as token-position rows, one for each byte; a recursive query joins
neighbouring rows with the merge table, contracts in every word its leftmost pair of least rank,
and goes on until no word has a pair left. Decoding joins the tokens with the vocabulary and
aggregates their bytes in order of position. Texts are put together from their words again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from salesmerge.llm.token_counts import word_starts
from salesmerge.llm.words import Slice, kept, slices, span_hashes

#: Words and bytes of one recursive query; positions must fit in 24 bits.
WORDS, BYTES = 50_000, 1 << 22
#: Longer words contract all disjoint places of their least pair in one step.
LONG = 64
#: Steps of one recursive query; unfinished words go on in another.
DEPTH = 200
#: Words a worker remembers.
KNOWN = 400_000

# One row of `found` is the least pair of a word, packed as rank, place, length of the left token
# and length of both, so that a plain minimum finds it. Tokens have at most 128 bytes.
_ONE = """
WITH RECURSIVE step (word, place, stop, token, live, depth) AS (
  SELECT word, place, stop, token, true, 0 FROM start
  UNION ALL (
    WITH found AS (
      SELECT a.word, min((m.rank::BIGINT << 40) | (a.place::BIGINT << 16)
                         | ((a.stop - a.place) << 8) | (b.stop - a.place)) AS x
      FROM step a JOIN step b ON a.stop = b.place
      JOIN merges m ON m.a = a.token AND m.b = b.token
      WHERE a.live AND b.live GROUP BY a.word
    ), least AS (
      SELECT word, (x >> 40)::INT AS rank, ((x >> 16) & 16777215)::INT AS place,
        (((x >> 16) & 16777215) + ((x >> 8) & 255))::INT AS middle,
        (((x >> 16) & 16777215) + (x & 255))::INT AS stop
      FROM found
    )
    SELECT s.word, s.place, CASE WHEN l.place = s.place THEN l.stop ELSE s.stop END,
      CASE WHEN l.place = s.place THEN l.rank ELSE s.token END, l.word IS NOT NULL, s.depth + 1
    FROM step s LEFT JOIN least l ON l.word = s.word
    WHERE s.live AND s.depth < {depth} AND (l.word IS NULL OR l.middle <> s.place)
  )
)
SELECT word, place, stop, token, live FROM step WHERE NOT live OR depth = {depth}
"""

# Contracting one pair again and again from the left equals contracting all its disjoint places
# at once: a pair with the new token has a higher rank. Of a chain of overlapping places
# (one token repeated), every second counts.
_ALL = """
WITH RECURSIVE step (word, place, stop, token, live, depth) AS (
  SELECT word, place, stop, token, true, 0 FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT a.word, a.place, b.place AS middle, b.stop, m.rank
      FROM step a JOIN step b ON a.stop = b.place
      JOIN merges m ON m.a = a.token AND m.b = b.token WHERE a.live AND b.live
    ), least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
    hits AS (
      SELECT p.*, CASE WHEN lag(p.middle) OVER (ORDER BY p.place) = p.place THEN 0 ELSE 1 END AS first
      FROM pairs p JOIN least l ON l.word = p.word AND l.rank = p.rank
    ), chains AS (SELECT *, sum(first) OVER (ORDER BY place) AS chain FROM hits),
    taken AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY chain ORDER BY place) AS n FROM chains
      ) WHERE n % 2 = 1
    )
    SELECT s.word, s.place, coalesce(t.stop, s.stop), coalesce(t.rank, s.token),
      l.word IS NOT NULL, s.depth + 1
    FROM step s LEFT JOIN least l ON l.word = s.word
    LEFT JOIN taken t ON t.place = s.place LEFT JOIN taken d ON d.middle = s.place
    WHERE s.live AND s.depth < {depth} AND d.middle IS NULL
  )
)
SELECT word, place, stop, token, live FROM step WHERE NOT live OR depth = {depth}
"""

_DECODE = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.place) AS hex
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.word ORDER BY t.word
"""


class Codec:
    """Merge table and vocabulary of a ranks file in an in-process DuckDB of one thread."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {
                base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in file if line.strip())
            }
        ranks = self.ranks
        merges = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        made = pa.table([pa.array(x, pa.int32()) for x in zip(*merges, strict=True)], ["a", "b", "rank"])
        self.db.register("made", made)
        self.db.execute("CREATE TABLE merges AS FROM made")
        listed = pa.table(
            [pa.array(ranks.values(), pa.int32()), pa.array([t.hex() for t in ranks])],
            ["token", "hex"],
        )
        self.db.register("listed", listed)
        self.db.execute("CREATE TABLE vocabulary AS FROM listed")
        self.known: dict[int, tuple[np.ndarray, bytes, bytes]] = {}

    def close(self) -> None:
        self.db.close()
        self.known.clear()

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty word."""
        out: list[np.ndarray | None] = [None] * len(words)
        open_words = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None:
                open_words.append(k)
            else:
                out[k] = np.array([whole], np.int32)
        for long in (False, True):
            part, size = [], 0
            for k in open_words:
                if (len(words[k]) > LONG) != long:
                    continue
                if part and (len(part) == WORDS or size + len(words[k]) + 1 > BYTES):
                    self._contract(words, part, out, long)
                    part, size = [], 0
                part.append(k)
                size += len(words[k]) + 1
            if part:
                self._contract(words, part, out, long)
        return out

    def _contract(
        self, words: list[bytes], part: list[int], out: list[np.ndarray | None], long: bool
    ) -> None:
        # A byte's place is its index here; the blank between words joins no rows.
        data = np.frombuffer(b"\0".join(words[k] for k in part), np.uint8)
        lengths = np.array([len(words[k]) for k in part])
        word = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
        place = (np.arange(len(word)) + word).astype(np.int32)
        # Single words beyond BYTES have places of their own range.
        query = (_ALL if long else _ONE).format(depth=DEPTH)
        rows = pa.table(
            [pa.array(x) for x in (word, place, place + np.int32(1), self.bytes[data[place]])],
            ["word", "place", "stop", "token"],
        )
        finished = []
        while len(rows):
            self.db.register("start", rows)
            got = self.db.sql(query).to_arrow_table()
            live = got["live"].to_numpy()
            finished.append(got.filter(pa.array(~live)).drop_columns(["live"]))
            rows = got.filter(pa.array(live)).drop_columns(["live"])
        done = pa.concat_tables(finished).sort_by("place")
        owner, tokens = done["word"].to_numpy(), done["token"].to_numpy()
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, k in enumerate(part):
            out[k] = tokens[cuts[i] : cuts[i + 1]]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of token ids, by ordered aggregation."""
        lengths = np.array([len(x) for x in ids], np.int64)
        out = [b""] * len(ids)
        if not lengths.sum():
            return out
        tokens = pa.table(
            [
                pa.array(np.repeat(np.arange(len(ids)), lengths)),
                pa.array(np.arange(lengths.sum())),
                pa.array(np.concatenate(ids).astype(np.int32)),
            ],
            ["word", "place", "token"],
        )
        self.db.register("tokens", tokens)
        got = self.db.sql(_DECODE).to_arrow_table()
        for k, text in zip(got["word"].to_pylist(), got["hex"].to_pylist(), strict=True):
            out[k] = bytes.fromhex(text)
        return out

    def words(self, piece: Slice) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Known words of a slice, which of them each place has, and each text's places."""
        data = piece.data
        if not len(data):
            return [], np.zeros(0, np.int64), np.zeros(len(piece.offsets), np.int64)
        first = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        texts = np.zeros(len(data) + 1, bool)
        texts[piece.offsets[:-1]] = True
        starts = np.zeros(len(data), bool)
        starts[np.flatnonzero(first)] = word_starts(points, texts[:-1][first])
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(data))
        distinct, one, back = np.unique(
            span_hashes(data, at, ends), return_index=True, return_inverse=True
        )
        keys = distinct.tolist()
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            raw = [data[at[one[k]] : ends[one[k]]].tobytes() for k in new]
            ids = self.encode(raw)
            for k, own, text in zip(new, ids, self.decode(ids), strict=True):
                shown = b" ".join([b"%d" % token for token in own.tolist()])
                self.known[keys[k]] = own, shown, text
        return [self.known[key] for key in keys], back, np.searchsorted(at, piece.offsets)


def _codec(path: str) -> Codec:
    own = kept("byte_bpe")
    if path not in own:
        own[path] = Codec(path)
    return own[path]


def encode(
    documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`id_column` and `ids`, the whole text's token ids (array of int) by the ranks in `path`.

    Words are those of the byte-level pattern of `public_tokenizers`; there are no special tokens. A
    null or empty text has no ids. Ids of rows may be null or repeat; one row in, one row
    out; other columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for piece in slices(batch.column(1)):
                known, back, places = codec.words(piece)
                rows = [
                    np.concatenate([known[k][0] for k in own]) if len(own) else np.zeros(0, np.int32)
                    for own in (back[a:b] for a, b in zip(places[:-1], places[1:], strict=True))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array(rows, pa.list_(pa.int32())),
                    ],
                    names=["id", "ids"],
                )

    narrow = documents.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """`id_column` and `decoded` (binary): the bytes of each row's `ids`; none for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                ids = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(codec.decode(ids), pa.binary())],
                    names=["id", "decoded"],
                )

    narrow = encoded.select(id_column, "ids")
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def round_trip(
    documents: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Digests of `encode` and of decoding its ids, without moving the ids out of the task.

    Returns `id_column`, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes), and with `with_ids` the ids themselves. Rows and
    nulls as in `encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for piece in slices(batch.column(1)):
                known, back, places = codec.words(piece)
                sizes = np.array([len(x[0]) for x in known], np.int64)
                shown = np.array([x[1] for x in known] + [b""], object)[:-1][back]
                text = np.array([x[2] for x in known] + [b""], object)[:-1][back]
                sums = np.concatenate([[0], np.cumsum(sizes[back])]) if len(back) else np.zeros(1, int)
                spans = list(zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
                digest = hashlib.sha256
                ids = []
                if with_ids:
                    each = [x[0] for x in known]
                    flat = np.concatenate([each[k] for k in back.tolist()] or [np.zeros(0, np.int32)])
                    ids = [pa.ListArray.from_arrays(pa.array(sums[places].astype(np.int32)), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array(sums[places[1:]] - sums[places[:-1]], pa.int64()),
                        pa.array([digest(b" ".join(shown[a:b].tolist())).hexdigest() for a, b in spans]),
                        pa.array([digest(b"".join(text[a:b].tolist())).hexdigest() for a, b in spans]),
                        *ids,
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
                )

    narrow = documents.select(id_column, text_column)
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + ", ids array<int>" * with_ids,
    )
