"""Best-fit packing of documents into sequences, certified by lower bounds.

Every document becomes token ids; those longer than a sequence are cut, and the pieces are dealt
to partitions of bounded size. A partition packs its pieces by best-fit decreasing and certifies its
number of sequences by a dual-feasible function: one that gives no full sequence a weight
above 1, so the weights' sum is a lower bound for any packing. A partition that needs more
sequences than its bound has a gap and exchanges all its pieces; one that meets its bound exchanges
those of its emptiest sequences, which the bound's rounding leaves. They are dealt anew to fewer
and larger partitions and packed again, until nothing is gained.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged
from salesmerge.llm.words import Slice, gather, slices, words

#: Pieces of a partition, about; it doubles with each exchange, so many times at most.
GROUP, DOUBLINGS = 8_192, 3
#: A certified partition keeps sequences whose missing weight adds up to this part of one at most.
KEPT_GAP = 0.02
#: Ids of known words that a worker holds before it starts anew.
KNOWN_IDS = 8 << 20


# --- token ids ------------------------------------------------------------------------------


class _Encoder:
    """A worker's tokenizer, asked once for each distinct word between white space.

    White space is dropped by the vocabulary's pre-tokenizer and joins nothing across it, so the
    ids of a text are those of its words, one word after the other.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [(t.content, k) for k, t in self.library.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = min(special, default=(None, -1))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each word. A special token between the words tells them apart in one call."""
        if self.mark is None or any(self.mark[:2] in text for text in texts):
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        whole = self.library.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0]
        ids = np.array(whole.ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) != len(texts) - 1:
            raise ValueError("the vocabulary doesn't keep its special tokens apart")
        starts = np.concatenate([[0], cuts + 1])
        return [ids[a:b] for a, b in zip(starts.tolist(), [*cuts.tolist(), len(ids)], strict=True)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [x for lo in range(0, len(texts), 256) for x in self._encode(texts[lo : lo + 256])]
        ends = self.bounds[-1] + np.cumsum([len(x) for x in found])
        slots = np.arange(len(keys)) + len(self.bounds) - 1
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.flat = np.concatenate([self.flat, *found])
        self.bounds = np.concatenate([self.bounds, ends])

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def ids(self, piece: Slice, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each closed by `end`, and the bounds of the texts."""
        if self.bounds[-1] > KNOWN_IDS:
            self._forget()
        read = words(piece)
        distinct, one, back = np.unique(read.hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(distinct)[1])
        if len(new):
            spans = zip(read.starts[one[new]].tolist(), read.ends[one[new]].tolist(), strict=True)
            data = piece.data.tobytes()
            self._learn(distinct[new], [data[a:b].decode("utf-8") for a, b in spans])
        slot = self.slots[self._known(distinct)[0]] if len(distinct) else np.zeros(0, np.int64)
        start, size = self.bounds[:-1], np.diff(self.bounds)
        own = slot[back]
        lengths = size[own]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        texts = np.diff(sums[read.rows]) + 1
        ends = np.cumsum(texts)
        out = np.full(int(ends[-1]) if len(ends) else 0, end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = self.flat[gather(start[own], lengths)]
        return out, np.concatenate([[0], ends])


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_pieces(
    documents: DataFrame, path: str, limit: int, end: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each document's ids, closed by `end`, in pieces of `limit`; only the last may be shorter.

    Returns `id_column`, piece (from 0), start, length, ids_crc32, ids. A null text is empty.
    """
    narrow = documents.select(id_column, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, bounds = encoder.ids(part, end)
                sizes = np.diff(bounds)
                pieces = -(-sizes // limit)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = bounds[row] + number * limit
                last = np.minimum(first + limit, bounds[row + 1])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                spans = zip((4 * first).tolist(), (4 * last).tolist(), strict=True)
                offsets = np.append(first, bounds[-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part.first + row)),
                        pa.array(number, pa.int32()),
                        pa.array(number * limit, pa.int64()),
                        pa.array(last - first, pa.int64()),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    kind = narrow.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"
    return narrow.mapInArrow(cut, schema)


# --- lower bounds ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    """A dual-feasible function over lengths 0 to `limit`, in whole numbers: `full` weighs 1."""

    weights: np.ndarray
    full: int

    def sequences(self, counts: np.ndarray) -> int:
        """The fewest sequences that pieces can need, `counts` of each length."""
        return -(-sum(int(w) * int(n) for w, n in zip(self.weights, counts) if n) // self.full)


def _stairs(limit: int, k: int) -> tuple[np.ndarray, int]:
    """The stair function of `k` steps: pieces just above a part of a sequence weigh as much."""
    x = np.arange(limit + 1, dtype=np.int64)
    exact = (k + 1) * x % limit == 0
    return np.where(exact, k * x, (k + 1) * x // limit * limit), k * limit


def best_bound(counts: np.ndarray, steps: int = 12) -> Bound:
    """The strongest of a family of dual-feasible functions for these counts by length.

    The family: the length itself and stair functions of 1 to `steps` steps, each also after
    shorter pieces than any threshold are left out and their complements count as full.
    """
    limit = len(counts) - 1
    x = np.arange(limit + 1, dtype=np.int64)
    best, value = (x, limit), -1.0
    for k in range(steps + 1):
        weights, full = (x, limit) if k == 0 else _stairs(limit, k)
        inner = np.concatenate([[0.0], np.cumsum(weights * counts, dtype=float)])
        above = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
        least = np.arange(limit // 2 + 1)  # pieces below `least` are left out
        total = inner[limit - least + 1] - inner[least] + full * (above[-1] - above[limit - least + 1])
        e = int(np.argmax(total))
        if total[e] / full > value + 1e-9:
            chosen = weights.copy()
            chosen[:e] = 0
            chosen[limit - e + 1 :] = full
            best, value = (chosen, full), total[e] / full
    return Bound(*best)


# --- packing --------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, given in descending length.

    A piece goes to the fullest sequence that has room for it, else to a new one. The free rooms
    are bits of one number, so the best fit is the lowest bit that is left.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, free, n = [[] for _ in range(limit + 1)], 0, 0
    for k, length in enumerate(lengths.tolist()):
        wide = free >> length
        if wide:
            room = length + (wide & -wide).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, own, n = limit, n, n + 1
        sequence[k], offset[k] = own, limit - room
        left = room - length
        if left:
            if not rooms[left]:
                free |= 1 << left
            rooms[left].append(own)
    return sequence, offset


def _pack_group(table: pa.Table, limit: int, bound: Bound, last: bool) -> pa.Table:
    """Pack one partition; `open` are the pieces of sequences that it hands on."""
    key, length = table["key"].to_numpy(), table["length"].to_numpy()
    order = np.lexsort((key, -length))
    key, length = key[order], length[order]
    sequence, offset = best_fit(length, limit)
    n = int(sequence.max()) + 1
    missing = bound.full - np.bincount(sequence, bound.weights[length], n)
    by_gap = np.argsort(missing, kind="stable")
    keep = np.cumsum(np.maximum(missing[by_gap], 0)) <= KEPT_GAP * bound.full
    handed = np.ones(n, bool)
    if n == -(-int(bound.weights[length].sum()) // bound.full):  # certified
        handed[by_gap[keep]] = False
    if last:
        handed[:] = False
    name = np.zeros(n, np.int64)
    name[sequence[offset == 0]] = key[offset == 0]
    return pa.table({"key": key, "length": length, "sequence_id": name[sequence], "offset": offset, "open": handed[sequence]})


def _packer(limit: int, bound: Bound, last: bool):
    return lambda table: _pack_group(table, limit, bound, last)


def _counts(pieces: DataFrame, limit: int) -> np.ndarray:
    """Number of pieces of each length below `limit`; at most that many rows."""
    out = np.zeros(limit + 1, np.int64)
    for row in pieces.where(F.col("length") < limit).groupBy("length").count().collect():
        out[row["length"]] = row["count"]
    return out


def place(pieces: DataFrame, limit: int, group: int = GROUP) -> tuple[DataFrame, int, int]:
    """Sequence and offset of pieces (key, length): (key, sequence_id, offset), bound, sequences.

    Keys are distinct. Both numbers count sequences of pieces shorter than `limit`; a whole
    sequence's piece is on its own. Stops when one partition is left or an exchange gains nothing.
    """
    spark = pieces.sparkSession
    counts = _counts(pieces, limit)
    bound = best_bound(counts)
    alone = pieces.where(F.col("length") == limit).select(
        "key", F.col("key").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    pool, left = pieces.where(F.col("length") < limit).select("key", "length"), int(counts.sum())
    placed, sequences, before, round_, size = [alone], 0, None, 0, group
    schema = "key bigint, length bigint, sequence_id bigint, offset bigint, open boolean"
    while left:
        groups = -(-left // size)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(groups)))
        packer = _packer(limit, bound, last=groups == 1)
        packed = staged(dealt.groupBy("part").applyInArrow(packer, schema), "packed")
        begins = F.col("offset") == 0
        n, open_, handed = packed.agg(
            F.count_if(begins & ~F.col("open")), F.count_if(begins & F.col("open")), F.count_if("open")
        ).first()
        gains = before is None or n + open_ < before[1]
        if gains:
            placed.append(packed.where("NOT open").select("key", "sequence_id", "offset"))
            sequences += n
            before = (packed.where("open").select("key", "sequence_id", "offset"), open_)
            pool, left = packed.where("open").select("key", "length"), handed
        elif groups == 1 or size >= group << DOUBLINGS:
            placed.append(before[0])  # as good before: keep that
            sequences += before[1]
            break
        round_, size = round_ + 1, min(2 * size, group << DOUBLINGS)
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    return whole, bound.sequences(counts), sequences


def pack(
    documents: DataFrame,
    path: str,
    limit: int = 4096,
    end: int = 1,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """Pack all documents into as few sequences of at most `limit` tokens as can be found.

    One row per piece: `id_column`, piece, start, length, ids_crc32, sequence_id, offset; with
    `with_ids` also ids. A document's ids are those of the tokenizer file at `path`, without added
    special tokens, then `end`; only longer ones are cut. Pieces of a sequence have no gaps
    between them. A null text is empty and has one token, `end`. Null and repeated ids are
    documents of their own; other columns are not read; an empty table gives no rows.
    """
    cut = token_pieces(documents, path, limit, end, id_column, text_column)
    if not with_ids:
        cut = cut.drop("ids")
    cut = staged(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed, _, _ = place(cut.select("key", "length"), limit, group)
    columns = [c for c in cut.columns if c not in ("key", "ids")]
    return cut.join(placed, "key").select(*columns, "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) out of pieces with ids: the pieces in order of their offset."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # `limit` ids at most
    return packed.groupBy("sequence_id").agg(pieces.alias("pieces")).select(
        "sequence_id", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids")
    )
