"""A navigable small-world graph as arrays, filled and searched in batches inside a task.

Distance is one minus the inner product. All queries of a batch walk at once: a step
takes the nearest open nodes of every query's beam, looks up their links, and merges
the neighbours not seen before into the beam. Insertion searches the graph for a batch
of new nodes, adds the nearest of the batch itself, and chooses links for spread.
"""

from __future__ import annotations

import math

import numpy as np

NONE = -1


class Graph:
    """Layers of links over vectors; a node's level is drawn geometrically from its number and ``seed``."""

    def __init__(self, dim: int, m: int = 16, ef_construction: int = 100, seed: int = 0):
        self.dim, self.m, self.ef_construction, self.seed = dim, m, ef_construction, seed
        self.data = np.empty((0, dim), dtype=np.float32)
        self.levels = np.empty(0, dtype=np.int8)
        self.links: list[np.ndarray] = []  # of each layer: node -> neighbours, filled up with NONE
        self.entry = NONE

    def __len__(self) -> int:
        return len(self.data)

    def width(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def draw_levels(self, first: int, count: int) -> np.ndarray:
        """Levels of nodes ``first`` and on: a layer up with a chance of one in ``m``."""
        u = np.array([np.random.Generator(np.random.PCG64([self.seed, i])).random() for i in range(first, first + count)])
        return np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(self.m)).astype(np.int8)

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of each row of ``q`` to its own row of nodes."""
        return 1 - np.einsum("id,id->i", q, self.data[nodes])

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, layer: int, open_at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest nodes that a best-first walk from ``start`` (a row of nodes for
        each query) finds in a layer, and their distances, nearest first."""
        queries, links = len(q), self.links[layer]
        ef = max(1, min(ef, len(self)))
        start = start[:, :ef]
        seen = np.zeros((queries, len(self)), dtype=bool)
        node = np.full((queries, ef), NONE, dtype=np.int32)
        dist = np.full((queries, ef), np.inf, dtype=np.float32)
        fresh = np.zeros((queries, ef), dtype=bool)
        r, c = np.nonzero(start != NONE)
        node[r, c] = start[r, c]
        dist[r, c] = self.distances(q[r], start[r, c])
        seen[r, start[r, c]] = fresh[r, c] = True
        active, step = np.arange(queries), min(open_at_once, max(1, ef // 8))
        while True:
            waiting = np.where(fresh[active], dist[active], np.inf)
            if step == 1:
                pick = waiting.argmin(axis=1)[:, None]
            else:
                pick = np.argpartition(waiting, step - 1, axis=1)[:, :step]
            finite = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            some = finite.any(axis=1)
            active, pick, finite = active[some], pick[some], finite[some]
            if not len(active):
                break
            fresh[active[:, None], pick] &= ~finite
            near = np.where(finite[:, :, None], links[node[active[:, None], pick]], NONE)
            new = np.zeros(near.shape, dtype=bool)
            for e in range(step):
                # One after another, so that a node is new once only.
                unseen = (near[:, e] != NONE) & ~seen[active[:, None], near[:, e]]
                new[:, e] = unseen
                a, w = np.nonzero(unseen)
                seen[active[a], near[a, e, w]] = True
            near, new = near.reshape(len(active), -1), new.reshape(len(active), -1)
            a, w = np.nonzero(new)
            d = np.full(near.shape, np.inf, dtype=np.float32)
            d[a, w] = self.distances(q[active[a]], near[a, w])
            all_d = np.concatenate([dist[active], d], axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            dist[active] = np.take_along_axis(all_d, best, axis=1)
            node[active] = np.take_along_axis(np.concatenate([node[active], near], axis=1), best, axis=1)
            fresh[active] = np.take_along_axis(np.concatenate([fresh[active], new], axis=1), best, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, axis=1)
        return np.where(np.isfinite(dist), np.take_along_axis(node, order, axis=1), NONE), dist

    def descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """A starting node for each query at layer ``down_to``: the nearest one met on the way from the top."""
        at = np.full((len(q), 1), self.entry, dtype=np.int32)
        for layer in range(len(self.links) - 1, down_to, -1):
            at = self.beam(q, at, 1, layer)[0]
        return at

    def search(self, q: np.ndarray, k: int, ef: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the ``k`` nearest nodes found by beams of ``max(ef, k)``, and their distances; NONE where there are fewer."""
        q = np.asarray(q, dtype=np.float32)
        nodes, dist = np.full((len(q), k), NONE, dtype=np.int32), np.full((len(q), k), np.inf, dtype=np.float32)
        for a in range(0, len(q) if len(self) else 0, batch):
            n, d = self.beam(q[a : a + batch], self.descend(q[a : a + batch], 0), max(ef, k), 0)
            nodes[a : a + batch, : n.shape[1]], dist[a : a + batch, : n.shape[1]] = n[:, :k], d[:, :k]
        return nodes, dist

    def chosen(self, node: np.ndarray, candidates: np.ndarray, limit: int, most: int = 64) -> np.ndarray:
        """Of each node's candidates at most ``limit`` as its links, the nearest first. One
        that is nearer to a chosen one than to the node is passed over; those passed over
        fill what room is left. Only the ``most`` nearest candidates are looked at."""
        out = np.full((len(node), limit), NONE, dtype=np.int32)
        for a in range(0, len(node), 512):
            c, own = candidates[a : a + 512], self.data[node[a : a + 512]]
            d = np.where(c == NONE, np.inf, 1 - np.einsum("ncd,nd->nc", self.data[c], own))
            order = np.argsort(d, axis=1, kind="stable")[:, : max(most, limit)]
            c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
            vectors = self.data[c]
            between = 1 - vectors @ vectors.transpose(0, 2, 1)
            picked, count = np.zeros(c.shape, dtype=bool), np.zeros(len(c), dtype=np.int64)
            for t in range(c.shape[1]):
                covered = (picked & (between[:, t] < d[:, t, None])).any(axis=1)
                picked[:, t] = ~covered & np.isfinite(d[:, t]) & (count < limit)
                count += picked[:, t]
            # Chosen ones, then those passed over, then nothing.
            rank = np.where(picked, 0, np.where(np.isfinite(d), 1, 2)) * c.shape[1] + np.arange(c.shape[1])
            order = np.argsort(rank, axis=1)[:, :limit]
            out[a : a + 512, : order.shape[1]] = np.where(np.isfinite(np.take_along_axis(d, order, axis=1)), np.take_along_axis(c, order, axis=1), NONE)
        return out

    def link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Nodes become neighbours of those they have chosen; full lists are chosen anew."""
        links, width = self.links[layer], self.width(layer)
        r, c = np.nonzero(chosen != NONE)
        other, source = chosen[r, c], nodes[r]
        new = ~(links[other] == source[:, None]).any(axis=1)  # two nodes of a batch may have chosen each other
        other, source = other[new], source[new]
        order = np.lexsort((self.distances(self.data[source], other), other))
        other, source = other[order], source[order]
        owner, first, count = np.unique(other, return_index=True, return_counts=True)
        place = np.arange(len(other)) - np.repeat(first, count)
        # Of very many that come at once the nearest.
        other, source, place = other[place < width], source[place < width], place[place < width]
        row = np.searchsorted(owner, other)
        arriving = np.full((len(owner), width), NONE, dtype=np.int32)
        arriving[row, place] = source
        both = np.concatenate([links[owner], arriving], axis=1)
        full = (both != NONE).sum(axis=1) > width
        if (~full).any():
            some = both[~full]
            links[owner[~full]] = np.take_along_axis(some, np.argsort(some == NONE, axis=1, kind="stable"), axis=1)[:, :width]
        if full.any():
            links[owner[full]] = self.chosen(owner[full], both[full], width)

    def add(self, vectors: np.ndarray, batch: int = 256, own: int | None = None) -> None:
        """Appends nodes; ``own`` links are chosen for each (by default as many as a list holds)."""
        vectors = np.asarray(vectors, dtype=np.float32).reshape(len(vectors), -1)
        if len(vectors) and vectors.shape[1] != self.dim:
            raise ValueError(f"a vector of {vectors.shape[1]} in a graph of {self.dim}")
        at = 0
        while at < len(vectors):
            size = max(32, min(batch, len(self) // 2)) if len(self) else 32
            self._insert(vectors[at : at + size], own)
            at += size

    def _insert(self, vectors: np.ndarray, own: int | None) -> None:
        before = len(self)
        levels = self.draw_levels(before, len(vectors))
        top = len(self.links) - 1
        old_entry = self.entry
        starts = {layer: self.descend(vectors, layer) for layer in range(top + 1)} if before else {}
        found = {}
        for layer in range(min(top, int(levels.max())), -1, -1) if before else ():
            mine = np.flatnonzero(levels >= layer)
            found[layer] = self.beam(vectors[mine], starts[layer][mine], self.ef_construction, layer)[0]
        self.data = np.concatenate([self.data, vectors])
        self.levels = np.concatenate([self.levels, levels])
        self.links = [np.concatenate([x, np.full((len(vectors), x.shape[1]), NONE, dtype=np.int32)]) for x in self.links]
        while len(self.links) <= levels.max():
            self.links.append(np.full((len(self), self.width(len(self.links))), NONE, dtype=np.int32))
        for layer in range(int(levels.max()) + 1):
            mine = np.flatnonzero(levels >= layer)
            nodes = (before + mine).astype(np.int32)
            # Nodes of the batch don't find each other in the graph: the nearest of them are candidates as well.
            d = 1 - vectors[mine] @ vectors[mine].T
            np.fill_diagonal(d, np.inf)
            beside = np.argsort(d, axis=1, kind="stable")[:, : 2 * self.m].astype(np.int32)
            beside = np.where(np.take_along_axis(d, beside, axis=1) < np.inf, nodes[beside], NONE)
            candidates = np.concatenate([found[layer], beside], axis=1) if layer in found else beside
            picked = self.chosen(nodes, candidates, min(own or self.width(layer), self.width(layer)))
            self.links[layer][nodes, : picked.shape[1]] = picked
            self.link_back(layer, nodes, picked)
        if old_entry == NONE or levels.max() > top:
            self.entry = before + int(levels.argmax())
