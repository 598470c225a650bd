"""Finding many names in many texts: a trie of tokens, walked from all places at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_WORD_KINDS = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"))
_JOINERS = frozenset((0x200C, 0x200D))


def is_word(point: int) -> bool:
    """Whether a code point belongs to a word: letters, marks, digits, connectors."""
    return unicodedata.category(chr(point)) in _WORD_KINDS or point in _JOINERS


def _word_flags(points: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(points, return_inverse=True)
    return np.array([is_word(p) for p in distinct.tolist()], bool)[back] if len(points) else np.zeros(0, bool)


class Tokens:
    """Runs of word characters and the runs between them, with a 64-bit hash of each."""

    def __init__(self, texts: Sequence[str]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        word = _word_flags(points)
        start = np.ones(len(points), bool)
        start[1:] = word[1:] != word[:-1]
        start[bounds[:-1][bounds[:-1] < len(points)]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(points))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), np.uint64(_ODD))]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), np.uint64(_ODD_INVERSE))]))
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            self.hashes = (sums[ends] - sums[at]) * down[at]
        #: Text of each token, and tokens of each text.
        self.text = np.searchsorted(bounds, at, side="right") - 1
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))


class NameTrie:
    """Names as chains of tokens; `goto` has a sorted key (node, token) for each edge.

    A name is a number by its place in the given list, and the least number that occurs in a text
    counts. All starts of a batch move down the trie together; a start whose next token has no edge
    drops out. So a text costs its tokens times the length of the names that begin there,
    whatever the number of names.
    """

    def __init__(self, names: Sequence[str]) -> None:
        read = Tokens(names)
        self.vocabulary = np.unique(read.hashes)
        token = np.searchsorted(self.vocabulary, read.hashes).tolist()
        edges: dict[int, int] = {}
        width, ends = len(self.vocabulary), {}
        for number in range(len(names)):
            node = 0
            for k in range(read.bounds[number], read.bounds[number + 1]):
                node = edges.setdefault(node * width + token[k], len(edges) + 1)
            ends.setdefault(node, number)
        self.goto = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[key] for key in self.goto.tolist()], np.int64)
        self.none = len(names)
        self.ends = np.full(len(edges) + 1, self.none, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def _step(self, node: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge for their token, and where those edges lead."""
        key = node * len(self.vocabulary) + token
        at = np.minimum(np.searchsorted(self.goto, key), len(self.goto) - 1)
        there = (self.goto[at] == key) & (token >= 0)
        return np.flatnonzero(there), self.next[at[there]]

    def least(self, texts: Sequence[str]) -> np.ndarray:
        """For each text the least number of a name in it that begins and ends with a token."""
        best = np.full(len(texts), self.none, np.int64)
        read = Tokens(texts)
        if not len(read.hashes) or not len(self.goto):
            return best
        at = np.minimum(np.searchsorted(self.vocabulary, read.hashes), len(self.vocabulary) - 1)
        token = np.where(self.vocabulary[at] == read.hashes, at, -1)
        place = np.flatnonzero(token >= 0)
        node = np.zeros(len(place), np.int64)
        while len(place):
            there, node = self._step(node, token[place])
            place = place[there]
            np.minimum.at(best, read.text[place], self.ends[node])
            inside = place + 1 < len(token)
            inside[inside] = read.text[place[inside] + 1] == read.text[place[inside]]
            place, node = place[inside] + 1, node[inside]
        return best


def least_names(column: pa.Array, trie: NameTrie, shown: Sequence[str], orders: Sequence[int]) -> pa.Array:
    """For each text (ord, display) of the least name in it; null without one."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    best = trie.least(texts)
    hit = best < trie.none
    number = np.where(hit, best, 0).tolist()
    found = [{"ord": orders[k], "display": shown[k]} if ok else None for k, ok in zip(number, hit.tolist(), strict=True)]
    return pa.array(found, pa.struct([("ord", pa.int32()), ("display", pa.string())]))
