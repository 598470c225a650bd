"""Removal of word sequences that occur more than once, by seed and extend.

Seeds: every window of `window` words has an anchor, the least of the hashes of its runs of
`seed` words (winnowing). Equal windows have the same anchor at the same place, so a window can
only repeat if its anchor does; anchors that occur once end here.

Extend: around each occurrence of a repeated anchor, the windows it is the anchor of are hashed,
so all extensions to the left and right that are long enough are compared at once. Occurrences
of one anchor meet by hash and window, never pair by pair: a copy of a passage costs one row for
each window, however often the passage occurs. A group of occurrences beyond `HOT` is split by
document; what is single within a split meets the other splits once more.

The words that repeated windows cover are the maximal repeats of at least `window` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import keys, staged
from salesmerge.llm.words import SPACES, Slice, Words, gather, runs, slices, words

#: Occurrences of one anchor that may meet in one task.
HOT = 5_000


def _owners(found: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hashes at all places."""
    hashes = runs(found.hashes, seed)
    n = len(found.hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, hashes
    value, place = hashes, np.arange(len(hashes))
    width, span = window - seed + 1, 1

    def least(shift: int) -> tuple[np.ndarray, np.ndarray]:
        first, second = value[: len(value) - shift], value[shift:]
        right = second < first  # of equal ones the first
        return np.where(right, second, first), np.where(right, place[shift:], place[: len(place) - shift])

    while 2 * span <= width:
        value, place = least(span)
        span *= 2
    if span < width:
        value, place = least(width - span)
    row_end = np.repeat(found.rows[1:], np.diff(found.rows))[:n]
    starts = np.flatnonzero(np.arange(n) + window <= row_end)
    return starts, place[starts], hashes


def _anchor_rows(documents: DataFrame, id_column: str, text_column: str, window: int, seed: int):
    """(a, b, place, anchor): every anchor of every row, once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for piece in slices(batch.column(0)):
                found = words(piece, SPACES)
                _, owner, hashes = _owners(found, window, seed)
                at = np.unique(owner)
                row = np.searchsorted(found.rows, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[piece.first + row]),
                        pa.array(b[piece.first + row]),
                        pa.array((at - found.rows[row]).astype(np.int32)),
                        pa.array(hashes[at].view(np.int64)),
                    ],
                    names=["a", "b", "place", "anchor"],
                )

    narrow = documents.select(text_column, *keys(id_column, text_column))
    return narrow.mapInArrow(find, "a bigint, b bigint, place int, anchor bigint")


def _window_rows(seeded: DataFrame, window: int, seed: int) -> DataFrame:
    """For each repeated anchor's occurrence: key, first window start, hashes of its windows."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists, splits = batch.column(3), batch.column(4)
            for piece in slices(batch.column(0)):
                found = words(piece, SPACES)
                starts, owner, hashes = _owners(found, window, seed)
                size = piece.last - piece.first
                part = lists.slice(piece.first, size)
                lengths = part.value_lengths().to_numpy()
                at = part.flatten().to_numpy() + np.repeat(found.rows[:-1], lengths)
                split_of = splits.slice(piece.first, size).flatten().to_numpy()
                order = np.argsort(at, kind="stable")
                at, split_of = at[order], split_of[order]
                at, one = np.unique(at, return_index=True)
                split_of = split_of[one]
                if not len(at):
                    continue
                slot = np.minimum(np.searchsorted(at, owner), len(at) - 1)
                hit = at[slot] == owner
                starts, slot = starts[hit], slot[hit]
                all_windows = runs(found.hashes, window)[starts].view(np.int64)
                first = np.flatnonzero(np.diff(slot, prepend=-1))
                group = slot[first]
                row = np.searchsorted(found.rows, at[group], side="right") - 1
                begin = (starts[first] - found.rows[row]).astype(np.int32)
                bounds = np.append(first, len(slot)).astype(np.int32)
                n_splits = split_of[group]
                keyed = b[piece.first + row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[piece.first + row]),
                        pa.array(keyed),
                        pa.array(begin),
                        pa.array(hashes[at[group]].view(np.int64)),
                        pa.array((keyed.view(np.uint64) % n_splits.astype(np.uint64)).astype(np.int32)),
                        pa.array(n_splits > 1),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(all_windows)),
                    ],
                    names=["a", "b", "begin", "anchor", "split", "is_split", "windows"],
                )

    schema = (
        "a bigint, b bigint, begin int, anchor bigint, split int, is_split boolean, "
        "windows array<bigint>"
    )
    return seeded.mapInArrow(extend, schema)


def _flagged(exploded: DataFrame) -> DataFrame:
    """Rows sorted by `hash` within partitions, with `again`: an equal one is next to it.

    `leads` marks the first of its equals. Only neighbours are compared, so memory stays flat.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the row whose next neighbour is in a later batch
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            value = table["hash"].to_numpy()
            same = value[1:] == value[:-1]
            up = np.concatenate([[last is not None and value[0] == last], same])
            down = np.concatenate([same, [False]])
            n = len(value) - 1
            if n:
                yield _told(table.slice(0, n), up[:n] | down[:n], ~up[:n])
                last = value[n - 1]
            held = table.slice(n).combine_chunks().to_batches()[0]
        if held is not None:
            value = held.column(held.schema.names.index("hash")).to_numpy()[0]
            up = np.array([last is not None and value == last])
            yield _told(pa.Table.from_batches([held]), up, ~up)

    return exploded.mapInArrow(
        compare,
        "a bigint, b bigint, begin int, place int, is_split boolean, hash bigint, "
        "again boolean, leads boolean",
    )


def _told(table: pa.Table, again: np.ndarray, leads: np.ndarray) -> pa.RecordBatch:
    table = table.append_column("again", pa.array(again)).append_column("leads", pa.array(leads))
    return table.combine_chunks().to_batches()[0]


def repeats(
    documents: DataFrame,
    window: int = 35,
    seed: int = 12,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(a, b, starts): for each row key, [begin, mask] pairs of window starts that repeat.

    Bit i of a mask stands for the window that starts at word begin + i. Staged.
    """
    if not window - 63 <= seed <= window:
        raise ValueError("an anchor's windows must fit in a mask of 64 bits")
    anchors = _anchor_rows(documents, id_column, text_column, window, seed)
    counts = anchors.groupBy("anchor").count().where("count > 1")
    seeds = (
        anchors.join(counts, "anchor")
        .groupBy("a", "b")
        .agg(
            F.collect_list(F.struct("place", F.ceil(F.col("count") / HOT).cast("int").alias("splits")))
            .alias("found")
        )
        .select(
            "a", "b", F.col("found.place").alias("places"), F.col("found.splits").alias("splits")
        )
    )
    seeds = staged(seeds, "seeds")
    keyed = documents.select(F.col(text_column).alias("text"), *keys(id_column, text_column))
    seeded = keyed.join(
        seeds, (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b"))
    ).select("text", "a", "b", "places", "splits")
    extended = (
        _window_rows(seeded, window, seed)
        .repartition("anchor", "split")
        .select("a", "b", "begin", "is_split", F.posexplode("windows").alias("place", "hash"))
        .select("a", "b", "begin", "place", "is_split", "hash")
    )
    told = _flagged(extended.sortWithinPartitions("hash"))
    bit = F.when(F.col("again"), F.expr("shiftleft(1L, place)")).otherwise(0)
    alone = F.col("is_split") & F.col("leads")
    masks = staged(
        told.where(F.col("again") | alone)
        .groupBy("a", "b", "begin")
        .agg(
            F.bit_or(bit).alias("mask"),
            F.collect_list(F.when(alone, F.struct("place", "hash"))).alias("open"),
        ),
        "masks",
    )
    across = (
        masks.select("a", "b", "begin", F.explode("open").alias("o"))
        .select("a", "b", "begin", "o.place", F.lit(False).alias("is_split"), "o.hash")
        .repartition("hash")
        .sortWithinPartitions("hash")
    )
    more = (
        _flagged(across).where("again").select("a", "b", "begin", F.expr("shiftleft(1L, place)").alias("mask"))
    )
    return (
        masks.select("a", "b", "begin", "mask")
        .where("mask != 0")
        .union(more)
        .groupBy("a", "b")
        .agg(F.collect_list(F.struct("begin", "mask")).alias("starts"))
    )


def _covered(piece: Slice, found: Words, starts: pa.Array, window: int) -> np.ndarray:
    """Which words of a slice a repeated window covers."""
    n = len(found.hashes)
    part = starts.slice(piece.first, piece.last - piece.first)
    lengths = part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    rows = part.flatten()
    begin, mask = (rows.field(k).to_numpy() for k in (0, 1))
    begin = begin + np.repeat(found.rows[:-1], lengths)
    edge = np.zeros(n + window + 64, np.int64)
    for bit in range(64):
        at = begin[(mask >> bit) & 1 == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(
    documents: DataFrame,
    window: int = 35,
    seed: int = 12,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All columns of the rows, with n_words, n_removed and kept (kept words, one space between).

    Words are runs without ASCII white space, unchanged. A word goes if a window of `window`
    words over it occurs at another place as well, in any row or the same one. A null or empty
    text has no words and kept is empty. Rows that repeat as a whole count as separate texts.
    A column of the input with one of the three names is replaced.
    """
    found = repeats(documents, window, seed, id_column, text_column)
    rest = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept")]
    keyed = documents.select(*rest, *keys(id_column, text_column))
    joined = keyed.join(
        found, (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")), "left"
    ).select(*rest, "starts")
    text_at = rest.index(text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(text_at)):
                size = piece.last - piece.first
                part = words(piece, SPACES)
                gone = _covered(piece, part, batch.column(len(rest)), window)
                sums = np.concatenate([[0], np.cumsum(gone)])
                # Kept words and one space before each, gathered in one go.
                at, to = part.starts[~gone], part.ends[~gone]
                kept_rows = part.rows - sums[part.rows]
                data = np.full(int((to - at).sum()) + len(at), 0x20, np.uint8)
                lengths = to - at
                begin = np.cumsum(lengths + 1) - lengths
                data[gather(begin, lengths)] = piece.data[gather(at, lengths)]
                begin = np.append(begin, len(data) + 1) - 1
                bounds = begin[kept_rows]
                raw = data.tobytes()
                kept = [
                    raw[x + 1 : y].decode("utf-8")
                    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                own = [batch.column(k).slice(piece.first, size) for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(np.diff(part.rows), pa.int64()),
                        pa.array(np.diff(sums[part.rows]), pa.int64()),
                        pa.array(kept, pa.string()),
                    ],
                    names=[*rest, "n_words", "n_removed", "kept"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-1])
    return joined.mapInArrow(cut, f"{fields}, n_words bigint, n_removed bigint, kept string")
