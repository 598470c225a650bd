"""Token counts by finite-state transduction, without merging pairs.

The byte-level BPE vocabulary is compiled into a deterministic transducer: an automaton over
the tokens' prefixes, whose transitions carry how the number of emitted tokens changes. An
encoding is valid exactly if each two adjacent tokens, joined, encode to themselves. So the last
token of a word's first bytes is the one token that ends there and fits the last token at
the place where it begins, and that is all the state a transition needs.

A text's bytes are cut into equal chunks that run side by side. A chunk with a word start
maps every entry state to one exit state; the bytes before that start, and a chunk without
one, depend on the exit of the chunk before. These maps are composed from left to right by
a prefix scan, and the emitted counts are summed by document.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from salesmerge.llm.words import Memo, Slice, gather, slices, span_hashes

#: Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: What may follow an apostrophe that begins a word (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Chunks that are run side by side.
LANES = 4096
#: Computed transitions (and fits of token pairs) that a worker keeps.
CACHE = 1 << 20


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def word_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer begins a word, by code point. texts: flags of text starts.

    Letters, numbers and other marks make words that take one space in front; of a run of
    white space before a word, only the last character is separate or part of that word.
    """
    kind = _classes()[points]
    n = len(points)
    before = np.concatenate([[SPACE], kind[:-1]])
    space, was_space = kind == SPACE, before == SPACE
    follows = np.ones(n, bool)  # the next code point is in another text or no white space
    follows[:-1] = ~space[1:] | texts[1:]
    more = np.zeros(n, bool)  # the text goes on
    more[:-1] = ~texts[1:]
    joined = np.concatenate([[False], points[:-1] == 0x20])
    starts = np.where(
        space, ~was_space | (follows & more), np.where(was_space, ~joined, kind != before)
    )
    starts |= texts
    marks = np.flatnonzero(starts & (points == ord("'")) & more)
    if len(marks):
        closed = np.cumsum(texts)
        for tail in CONTRACTIONS:
            at = marks[marks + len(tail) < n]
            at = at[closed[at + len(tail)] == closed[at]]
            for k, c in enumerate(tail, 1):
                at = at[points[at + k] == ord(c)]
            starts[at + 1] = False
            over = at + 1 + len(tail)
            starts[over[over < n]] = True
    return starts


class Transducer:
    """A byte-level BPE vocabulary as a transducer that runs many lanes of bytes at once.

    A state is the longest suffix of the word's bytes that begins a token (a node of the
    compiled automaton) with the last token and count at each earlier place, which is where
    a later token may begin. Reading a byte emits the change of the count.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], ranks: dict[bytes, int]) -> None:
        self._compile(ranks)
        n = max(ranks.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = np.zeros((len(merges), 3), np.int64)
        for k, (a, b) in enumerate(merges):
            pairs[k] = ranks[a], ranks[b], ranks[a + b]
        first = pairs[::-1]  # of two ways to one token the first made stays
        self.left[first[:, 2]], self.right[first[:, 2]] = first[:, 0], first[:, 1]
        order = np.argsort(pairs[:, 0] << 20 | pairs[:, 1])
        self.pair_keys = (pairs[:, 0] << 20 | pairs[:, 1])[order]
        self.pair_ranks = pairs[order, 2]
        # Direct-mapped caches of computed transitions and fits; a miss is computed again.
        self.moves = np.full(CACHE, -1, np.int64)
        self.moved = np.zeros(CACHE, np.int32)
        self.fits = np.full(CACHE, -1, np.int64)

    def _compile(self, ranks: dict[bytes, int]) -> None:
        """Trie of the tokens with failure links and the tokens that end at each node."""
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        for token, rank in sorted(ranks.items()):
            node = 0
            for byte in token:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
                    token_at.append(-1)
            token_at[node] = rank
        n = len(children)
        fail, last = [0] * n, [-1] * n
        self.shorter = np.full(max(ranks.values()) + 1, -1)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        queue = list(children[0].values())
        for node in queue:
            last[node] = token_at[node] if token_at[node] >= 0 else last[fail[node]]
            if token_at[node] >= 0:
                self.shorter[token_at[node]] = last[fail[node]]
            for byte, child in children[node].items():
                back = fail[node]
                while back and byte not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(byte, 0)
                queue.append(child)
        self.fail, self.last = np.array(fail), np.array(last)
        edges = [(a << 8 | byte, b) for a, own in enumerate(children) for byte, b in own.items()]
        self.edges, self.targets = (np.array(x) for x in zip(*sorted(edges), strict=True))

    def _move(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The automaton's next node of each lane."""
        keys = nodes << 8 | data
        slot = _slot(keys)
        out = self.moved[slot].astype(np.int64)
        miss = np.flatnonzero(self.moves[slot] != keys)
        if len(miss):
            at, rest = nodes[miss], np.arange(len(miss))
            found = np.zeros(len(miss), np.int64)
            while len(rest):
                want = at[rest] << 8 | data[miss[rest]]
                place = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
                hit = self.edges[place] == want
                found[rest[hit]] = self.targets[place[hit]]
                rest = rest[~hit & (at[rest] > 0)]
                at[rest] = self.fail[at[rest]]
            out[miss] = found
            self.moves[slot[miss]] = keys[miss]
            self.moved[slot[miss]] = found
            # Rivals for a slot: the key written last must have its own value.
            lost = self.moves[slot[miss]] != keys[miss]
            self.moves[slot[miss[lost]]] = -1
        return out

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, joined, is encoded as those two."""
        keys = left << 20 | right
        slot = _slot(keys)
        held = self.fits[slot]
        out = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != keys)
        if len(miss):
            unique, back = np.unique(keys[miss], return_inverse=True)
            made = self._judge(unique >> 20, unique & 0xFFFFF)
            out[miss] = made[back]
            self.fits[_slot(unique)] = unique << 1 | made
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the merges next to the border, latest first; no earlier merge may cross it."""
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), 1 << 60)
        good = np.zeros(len(left), bool)
        rest = np.arange(len(left))
        while len(rest):
            a, b = left[rest], right[rest]
            want = a << 20 | b
            place = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[place] == want) & (self.pair_ranks[place] < limit[rest])
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            undo_a = ~whole_a & ((a > b) | whole_b)
            limit[rest] = np.where(undo_a, a, b + 1)
            left[rest] = np.where(undo_a, self.right[a], a)
            right[rest] = np.where(undo_a, b, self.left[b])
            over = whole_a & whole_b
            good[rest] = over & ~crossed
            rest = rest[~crossed & ~over]
        return good

    def _read(
        self, data: np.ndarray, at: np.ndarray, node: np.ndarray, begin: np.ndarray,
        token: np.ndarray, count: np.ndarray,
    ) -> np.ndarray:
        """Read the byte at place `at` of each lane; its word began at `begin`."""
        node = self._move(node, data)
        ends, rest = self.last[node], np.arange(len(at))
        while len(rest):
            tried, place = ends[rest], at[rest]
            before = place - self.length[tried]
            whole = before < begin[rest]
            fits = whole | self._fit(token[before], tried)
            done = rest[fits]
            token[at[done]] = ends[done]
            count[at[done]] = np.where(whole[fits], 0, count[before[fits]]) + 1
            rest = rest[~fits]
            ends[rest] = self.shorter[ends[rest]]
        return node

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """At each byte, the tokens of its word up to there; `starts` flags word starts."""
        n = len(data)
        lanes = max(1, min(LANES, n // 128))
        width = -(-n // lanes)
        lanes = -(-n // width)
        token, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
        first = np.arange(lanes) * width
        size = np.minimum(width, n - first)
        flags = np.flatnonzero(starts)
        head = np.searchsorted(flags, first)
        head = np.where(head < len(flags), flags[np.minimum(head, len(flags) - 1)], n) - first
        constant = head < size  # such a chunk's exit doesn't depend on its entry
        head = np.minimum(head, size)
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        exit_node = np.zeros(lanes, np.int64)

        def run(live: np.ndarray, node: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            at, until = first[live] + start, first[live] + stop
            while len(live):
                on = at < until
                if not on.all():
                    exit_node[live[~on]] = node[~on]
                    live, node, at, until = live[on], node[on], at[on], until[on]
                    continue
                node = np.where(starts[at], 0, node)
                node = self._read(data[at], at, node, begin[at], token, count)
                at = at + 1

        own = np.flatnonzero(constant)
        run(own, np.zeros(len(own), np.int64), head[own], size[own])
        # Compose the maps: a head runs once the exit before it is known.
        known = constant.copy()
        todo = np.flatnonzero(np.concatenate([[False], known[:-1]]) & (head > 0))
        while len(todo):
            kept = exit_node[todo].copy()
            run(todo, exit_node[todo - 1], np.zeros(len(todo), np.int64), head[todo])
            through = todo[~constant[todo]]
            closed = constant[todo]
            exit_node[todo[closed]] = kept[closed]
            known[through] = True
            after = through[through + 1 < lanes] + 1
            todo = after[head[after] > 0]
        return count


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(20) & np.int64(CACHE - 1)


_MACHINES: dict[str, tuple[Transducer, list[bytes], Memo]] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def machine(path: str) -> tuple[Transducer, list[bytes], Memo]:
    """The worker's transducer for a vocabulary file, its special strings, and known words."""
    if path not in _MACHINES:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocabulary = spec["model"]["vocab"].items()
        ranks = {raw(token): rank for token, rank in vocabulary if token not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(raw(a), raw(b)) for a, b in pairs]
        _MACHINES[path] = (
            Transducer(merges, ranks),
            sorted(s.encode() for s in special),
            Memo(),
        )
    return _MACHINES[path]


def _texts(piece: Slice, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without special strings, starts of the texts between them, special tokens by row."""
    counts = np.zeros(piece.last - piece.first, np.int64)
    data = piece.data.tobytes()
    keep = np.ones(len(data), bool)
    cuts = [piece.offsets[:-1]]
    for mark in special:
        at = data.find(mark)
        while at >= 0:
            row = int(np.searchsorted(piece.offsets, at, side="right")) - 1
            if at + len(mark) <= piece.offsets[row + 1] and keep[at : at + len(mark)].all():
                counts[row] += 1
                keep[at : at + len(mark)] = False
                cuts.append(np.array([at + len(mark)]))
                at = data.find(mark, at + len(mark))
            else:
                at = data.find(mark, at + 1)
    places = np.concatenate(cuts)
    shift = np.concatenate([[0], np.cumsum(~keep)])
    starts = np.zeros(len(data) + 1, bool)
    starts[places - shift[places]] = True
    kept = piece.data[keep]
    return kept, starts[: len(kept)], counts, piece.offsets - shift[piece.offsets]


def count_slice(piece: Slice, path: str) -> np.ndarray:
    """Tokens of each text of a slice."""
    transducer, special, memo = machine(path)
    data, texts, counts, offsets = _texts(piece, special)
    if not len(data):
        return counts
    # Flags by code point, moved to the first byte of each.
    first = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data), bool)
    starts[np.flatnonzero(first)] = word_starts(points, texts[first])
    # Each distinct word of the slice is read once, if the worker doesn't know it yet.
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(data))
    distinct, one, back = np.unique(
        span_hashes(data, at, ends), return_index=True, return_inverse=True
    )
    known = memo.get(distinct)
    new = np.flatnonzero(known < 0)
    if len(new):
        lengths = (ends - at)[one[new]]
        apart = data[gather(at[one[new]], lengths)]
        begin = np.zeros(len(apart), bool)
        stops = np.cumsum(lengths)
        begin[stops - lengths] = True
        known[new] = transducer.counts(apart, begin)[stops - 1]
        memo.put(distinct[new], known[new])
    word_tokens = known[back]
    sums = np.concatenate([[0], np.cumsum(word_tokens, dtype=np.int64)])
    word = np.searchsorted(at, offsets)
    return counts + sums[word[1:]] - sums[word[:-1]]


def token_counts(
    documents: DataFrame,
    path: str,
    limit: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Exact number of tokens of each whole text under a byte-level BPE vocabulary.

    Returns `id_column`, n_bytes, n_tokens, over_limit (n_tokens > `limit`). A null text
    counts as empty and has 0 tokens; ids may be null or repeat, one row comes out for
    each row that goes in; other columns are not read. `path` names a file that every
    executor has. One pass, no shuffle; nothing is cut, however long a text is.
    """
    narrow = documents.select(id_column, text_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                tokens = count_slice(piece, path)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array(np.diff(piece.offsets), pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens > limit),
                    ],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = narrow.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return narrow.mapInArrow(count, schema)
