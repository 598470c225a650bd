"""Vectorised words and word hashes of whole Arrow batches, in bounded slices.

A slice is a run of rows with at most `SLICE_BYTES` of text; a longer text is a slice of its
own. So memory follows the longest single text, never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bytes that end a word of op10's contract: space, tab to carriage return.
SPACES = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes that end a word for shingles: every ASCII byte but letters and digits.
MARKS = frozenset(b for b in range(128) if not chr(b).isalnum())


#: What a worker keeps from one task to the next, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this operator keeps in the worker between tasks; all that others keep is dropped.

    A worker lives through the stages of several operators, and what it kept for all of them would add up.
    """
    for name in [name for name in _KEPT if name != operator]:
        for value in _KEPT.pop(name).values():
            value.close()
        pa.default_memory_pool().release_unused()
    return _KEPT.setdefault(operator, {})


class Slice(NamedTuple):
    """Rows `first` to `last` of a batch; `data` holds their UTF-8, `offsets` each row's start."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


class Words(NamedTuple):
    """All words of a slice in order; row r has words `rows[r]` to `rows[r + 1]`."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(
            first,
            last,
            body[bounds[first] : bounds[last]],
            bounds[first : last + 1] - bounds[first],
        )
        first = last


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up = _powers(_ODD, n + 1)
                self.down = _powers(_ODD_INVERSE, n + 1)
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


@cache
def _breaks(marks: frozenset[int]) -> np.ndarray:
    return np.isin(np.arange(256), sorted(marks))


def words(piece: Slice, marks: frozenset[int] = SPACES, fold: bool = False) -> Words:
    """Words between `marks`, with a 64-bit hash of each; `fold` ignores ASCII case."""
    data, offsets = piece.data, piece.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~_breaks(marks)[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _POWERS.upto(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[fold][data] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes (or of other numbers) of each span."""
    values = _VALUES[False][data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1))
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all places of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


class Memo:
    """A worker's bounded memory of one number for each 64-bit key; newer keys replace older."""

    def __init__(self, bits: int = 20) -> None:
        self.bits = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where unknown."""
        slot = keys >> self.bits
        return np.where(self.keys[slot] == keys, self.values[slot], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Remember numbers of distinct keys."""
        slot = keys >> self.bits
        self.keys[slot] = keys
        kept = self.keys[slot] == keys
        self.values[slot[kept]] = values[kept]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive words (one value for each start)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(_ODD) + hashes[k : k + n]
    return mix(total)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """As `shingles`, by prefix sums: its cost doesn't depend on `size`."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[:n])


def valid(rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which starts have their whole run of `size` words in one row."""
    n = n - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    row_end = np.repeat(rows[1:], np.diff(rows))[:n]
    return np.arange(n) + size <= row_end
