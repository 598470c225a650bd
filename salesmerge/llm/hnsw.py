"""A hierarchical navigable small-world graph over unit vectors, in whole-array steps.

Layers are built from the top; each layer's vectors are inserted in batches that search the graph made so
far and compare with each other directly. Many queries walk the graph side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LINKS, BEAM, BATCH = 32, 64, 1024
_LAYER = 16  # each layer has one of so many vectors of the layer below
_WIDE = 4  # nodes a query expands at once
_WIDTHS = (8, 24, 2 * LINKS)  # new links of a node that are chosen from together


@dataclass
class Graph:
    """Unit vectors with, from the bottom, each layer's nodes and their links (-1: none)."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    links: list[np.ndarray]  # of layer l: a row for each vector
    islands: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        top = 0
        while n / _LAYER ** (top + 1) >= BATCH / 4:
            top += 1
        layers = [np.flatnonzero(draw < float(_LAYER) ** -level) for level in range(top + 1)]
        graph = cls(np.ascontiguousarray(vectors, np.float32), layers, [])
        graph.links = [np.full((n, LINKS), -1, np.int32) for _ in layers]
        for level in range(top, -1, -1):
            graph._fill(level, draw)
        graph.islands = graph._unreached()
        return graph

    def _unreached(self) -> np.ndarray:
        """A node of each part of the bottom layer that no walk from the entry can reach.

        Tight groups of copies choose only each other as neighbours; every query looks at the
        islands' nodes directly and starts at the nearest as well.
        """
        reached = np.zeros(len(self.vectors), bool)
        out: list[int] = []
        start = int(self.layers[-1][0])
        while True:
            front = np.array([start])
            reached[front] = True
            while len(front):
                near = self.links[0][front].reshape(-1)
                near = np.unique(near[near >= 0])
                front = near[~reached[near]]
                reached[front] = True
            left = np.flatnonzero(~reached)
            if not len(left):
                return np.array(out, np.int64)
            start = int(left[0])
            out.append(start)

    def _fill(self, level: int, draw: np.ndarray) -> None:
        nodes = self.layers[level]
        nodes = nodes[np.argsort(draw[nodes], kind="stable")]  # upper nodes first
        done = 0
        while done < len(nodes):
            size = min(BATCH, max(BATCH // 4, done), len(nodes) - done)
            batch = nodes[done : done + size]
            own = self.vectors[batch]
            # Neighbours within the batch, and those the graph so far finds.
            near = own @ own.T
            np.fill_diagonal(near, -np.inf)
            k = min(BEAM, size - 1)
            ids = np.full((size, 0), -1, np.int64)
            if k > 0:
                ids = batch[np.argpartition(-near, k - 1, axis=1)[:, :k]]
            if done:
                found, _ = self.search(own, BEAM, level, nodes[:1])
                ids = np.concatenate([ids, found], axis=1)
            picked = self._select(own, ids)
            self.links[level][batch] = picked
            self._back(level, batch, picked)
            done += size

    def _select(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the candidates up to LINKS, nearest first, none nearer to a chosen one than to its owner."""
        out = np.full((len(own), LINKS), -1, np.int32)
        for lo in range(0, len(own), 256):
            part = ids[lo : lo + 256]
            vectors = self.vectors[part]
            sims = np.einsum("qd,qkd->qk", own[lo : lo + 256], vectors)
            sims[part < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * BEAM]
            part = np.take_along_axis(part, order, 1)
            sims = np.take_along_axis(sims, order, 1)
            vectors = np.take_along_axis(vectors, order[:, :, None], 1)
            between = vectors @ vectors.transpose(0, 2, 1)
            chosen = np.zeros(part.shape, bool)
            count = np.zeros(len(part), int)
            for k in range(part.shape[1]):
                if not np.isfinite(sims[:, k]).any() or (count >= LINKS).all():
                    break
                hidden = (chosen & (between[:, k] > sims[:, k, None])).any(1)
                take = ~hidden & np.isfinite(sims[:, k]) & (count < LINKS)
                chosen[:, k] = take
                out[lo + np.flatnonzero(take), count[take]] = part[take, k]
                count += take
        return out

    def _back(self, level: int, batch: np.ndarray, picked: np.ndarray) -> None:
        """Link the chosen neighbours back, choosing anew where a node gets too many."""
        source = np.repeat(batch, LINKS)
        target = picked.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("kd,kd->k", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        keep = place < 2 * LINKS  # the nearest; a hub's farther ones link to it one way
        row = np.repeat(np.arange(len(nodes)), count)[keep]
        fresh = np.full((len(nodes), 2 * LINKS), -1, np.int64)
        fresh[row, place[keep]] = source[keep]
        least = 0
        for width in _WIDTHS:  # most nodes get few new links
            some = np.flatnonzero((count > least) & ((count <= width) | (width == 2 * LINKS)))
            own, new, least = nodes[some], fresh[some, :width], width
            held = self.links[level][own]
            new[(new[:, :, None] == held[:, None, :]).any(2)] = -1
            self.links[level][own] = self._select(self.vectors[own], np.concatenate([held, new], axis=1))

    def search(
        self, queries: np.ndarray, beam: int, level: int = 0, entry: np.ndarray | None = None,
        floor: float = np.inf,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the `beam` nearest found (unordered; -1 and -inf pad).

        Walks also start at every island of similarity `floor`, at the four nearest at least.
        """
        ids = np.full((len(queries), beam), -1, np.int64)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        block = int(np.clip(20_000_000 // len(self.vectors), 16, 512))
        if beam > 256:
            block = max(16, block // 4)
        stamp = np.full(min(block, len(queries)) * len(self.vectors), -1, np.int32)
        for lo in range(0, len(queries), block):
            part = queries[lo : lo + block]
            starts = np.full((len(part), 1), self.layers[-1][0])
            for upper in range(len(self.layers) - 1, level, -1):
                starts, _ = self._walk(part, starts, 4, upper, stamp)
            if level == 0 and len(self.islands):
                near = part @ self.vectors[self.islands].T
                k = min(max(4, int((near >= floor).sum(1).max())), len(self.islands))
                nearest = self.islands[np.argpartition(-near, k - 1, axis=1)[:, :k]]
                starts = np.concatenate([starts, nearest], axis=1)
            if entry is not None and level == len(self.layers) - 1:
                starts = np.tile(entry, (len(part), 1))
            ids[lo : lo + block], sims[lo : lo + block] = self._walk(part, starts, beam, level, stamp)
        return ids, sims

    def _walk(self, queries, starts, beam, level, stamp):
        n, rows = len(self.vectors), np.arange(len(queries))[:, None]
        stamp[:] = -1
        ids = np.full((len(queries), beam), -1, np.int64)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        opened = np.ones((len(queries), beam), bool)
        new = np.where(starts >= 0, starts, -1)
        live = np.arange(len(queries))
        while len(live):
            # New nodes that this query hasn't seen, each once.
            flat = live[:, None] * n + new
            fresh = (new >= 0) & (stamp[np.where(new >= 0, flat, 0)] < 0)
            tag = np.arange(new.size, dtype=np.int32).reshape(new.shape)
            stamp[flat[fresh]] = tag[fresh]
            fresh &= stamp[np.where(new >= 0, flat, 0)] == tag
            value = np.full(new.shape, -np.inf, np.float32)
            at_row, at_col = np.nonzero(fresh)
            value[at_row, at_col] = np.einsum(
                "kd,kd->k", queries[live[at_row]], self.vectors[new[at_row, at_col]]
            )
            all_ids = np.concatenate([ids[live], new], 1)
            all_sims = np.concatenate([sims[live], value], 1)
            all_open = np.concatenate([opened[live], np.zeros(new.shape, bool)], 1)
            if all_ids.shape[1] > beam:
                best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_open = (
                    np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open)
                )
            width = all_ids.shape[1]
            all_open[~np.isfinite(all_sims)] = True
            ids[live, :width], sims[live, :width] = all_ids, all_sims
            opened[live, :width] = all_open
            waiting = np.where(all_open, -np.inf, all_sims)
            k = min(_WIDE, width)
            next_ = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            good = np.isfinite(np.take_along_axis(waiting, next_, 1))
            opened[live[:, None], next_] = True
            nodes = np.where(good, np.take_along_axis(all_ids, next_, 1), -1)
            more = good.any(1)
            live, nodes = live[more], nodes[more]
            linked = self.links[level][nodes].astype(np.int64)
            linked[nodes < 0] = -1
            new = linked.reshape(len(live), k * LINKS)
        ids[~np.isfinite(sims)] = -1
        return ids, sims
