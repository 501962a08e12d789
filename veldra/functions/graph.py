"""Hierarchical navigable small-world graphs over one shard, held as flat neighbour arrays and searched many queries at a time.

Nodes are ordered by falling level, so every layer is a prefix of the nodes. A layer is one int32 array: a row holds a node's own
links, chosen diverse among its candidates, then the closest links that later nodes made to it, and last the nodes it has adopted:
every node is taken in by the closest earlier one with room, and such a link is never given up, so all nodes stay reachable. Inserting and searching run
over batches of nodes with array operations; layers of up to ``EXACT`` nodes are linked from all pairs of their own.
"""

from __future__ import annotations

import numpy as np

OWN, BACK, KIDS, BATCH, EXACT = 12, 14, 6, 512, 2048
CANDIDATES = 16
#: One of this many nodes of a layer is in the layer above.
RATIO = 8
DEEPER = 4
TOP = 256


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Level of each node, geometric with one of ``RATIO`` nodes going up, from a hash of its id; at most 12."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    u = (x.astype(np.float64) + 1) / 2.0**64
    return np.minimum(-np.log(u) / np.log(RATIO), 12).astype(np.int64)


def _diverse(v: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those closer to the node than to any chosen before, then the closest."""
    b, c = ids.shape
    own = v[np.maximum(ids, 0)]
    among = np.matmul(own, own.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    worst = np.full((b, c), -2.0, np.float32)
    for i in range(c):
        take = (ids[:, i] >= 0) & (sims[:, i] > worst[:, i]) & (count < most)
        chosen[:, i] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, among[:, i]), worst)
    order = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in falling order."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def _heights(sizes: list[int]) -> list[int]:
    return [s for i, s in enumerate(sizes) if i == 0 or sizes[i - 1] > TOP]


class Graph:
    """``own``: links a node makes; ``candidates``: nodes they are chosen from; ``exact``: nodes up to which these come from all pairs.

    ``loose``: a node or query that finds less than this similarity is searched again ``DEEPER`` times as broadly, since a small
    group of vectors can lie hidden behind a large one that fills the first search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, candidates: int = CANDIDATES, loose: float = -2.0, own: int = OWN, exact: int = EXACT):
        self.loose, self.own, self.exact = loose, own, exact
        order = np.lexsort((ids, -levels_of(ids)))
        self.ids, self.v = ids[order], np.ascontiguousarray(vectors[order], np.float32)
        level = levels_of(self.ids)
        sizes = [int((level >= n).sum()) for n in range(int(level.max(initial=0)) + 1)]
        # a top layer of over TOP nodes isn't possible; empty or tiny layers above it are left out
        self.sizes = _heights(sizes)
        self.layers: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(self.sizes)
        for n in range(len(self.sizes) - 1, -1, -1):
            self._link(n, candidates)

    @classmethod
    def restored(cls, ids: np.ndarray, vectors: np.ndarray, links: list[np.ndarray], loose: float = -2.0) -> Graph:
        """A graph from its nodes in their order and the links of each layer."""
        graph = cls.__new__(cls)
        graph.loose, graph.ids, graph.v, graph.layers = loose, ids, np.ascontiguousarray(vectors, np.float32), links
        graph.sizes = [len(x) for x in links]
        return graph

    def _link(self, n: int, candidates: int) -> None:
        size, OWN = self.sizes[n], self.own  # noqa: N806
        own = np.full((size, OWN), -1, np.int32)
        back, near = np.full((size, BACK), -1, np.int32), np.full((size, BACK), -2.0, np.float32)
        kids = np.zeros(size, np.int64)
        self.layers[n] = flat = np.full((size, OWN + BACK + KIDS), -1, np.int32)
        for a in range(0, size, BATCH):
            b = min(a + BATCH, size)
            rows = np.arange(a, b)
            block = self.v[a:b]
            if b <= self.exact:
                ids = np.broadcast_to(np.arange(b, dtype=np.int32), (b - a, b))
                sims = block @ self.v[:b].T
            else:
                found, close = self._thorough(n, block, candidates, a, 0)
                ids = np.concatenate([found, np.broadcast_to(rows.astype(np.int32), (b - a, b - a))], 1)
                sims = np.concatenate([close, block @ block.T], 1)
            sims = np.where((ids == rows[:, None]) | (ids < 0), -2.0, sims)
            at = _best(sims, candidates)
            sims = np.take_along_axis(sims, at, 1)
            ids = np.where(sims > -2.0, np.take_along_axis(ids, at, 1), -1)
            own[a:b] = np.pad(_diverse(self.v, ids, sims, OWN), ((0, 0), (0, max(0, OWN - ids.shape[1]))), constant_values=-1)[:, :OWN]
            flat[a:b, :OWN] = own[a:b]
            # adoption by the closest earlier node with room
            alone = np.arange(b - a) + a > 0
            for c in range(ids.shape[1]):
                child = np.flatnonzero(alone & (ids[:, c] >= 0) & (ids[:, c] < rows))
                if not len(child):
                    continue
                child = child[np.argsort(ids[child, c], kind="stable")]
                parent = ids[child, c]
                fresh = np.append(True, parent[1:] != parent[:-1])
                slot = kids[parent] + np.arange(len(child)) - np.maximum.accumulate(np.where(fresh, np.arange(len(child)), 0))
                room = slot < KIDS
                flat[parent[room], OWN + BACK + slot[room]] = rows[child[room]]
                np.add.at(kids, parent[room], 1)
                alone[child[room]] = False
            # links back
            src, dst = np.repeat(rows, ids.shape[1]), ids.ravel()
            s = sims.ravel()
            ok = dst >= 0
            src, dst, s = src[ok], dst[ok], s[ok]
            order = np.lexsort((-s, dst))
            src, dst, s = src[order], dst[order], s[order]
            first = np.append(True, dst[1:] != dst[:-1])
            rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
            few = rank < BACK
            src, dst, s, rank = src[few], dst[few], s[few], rank[few]
            target, place = np.unique(dst, return_inverse=True)
            new_ids, new_near = np.full((len(target), BACK), -1, np.int32), np.full((len(target), BACK), -2.0, np.float32)
            new_ids[place, rank], new_near[place, rank] = src, s
            both_ids, both_near = np.concatenate([back[target], new_ids], 1), np.concatenate([near[target], new_near], 1)
            at = _best(both_near, BACK)
            back[target], near[target] = np.take_along_axis(both_ids, at, 1), np.take_along_axis(both_near, at, 1)
            flat[target, OWN : OWN + BACK] = back[target]

    def _entries(self, n: int, q: np.ndarray, breadth: int = 6) -> np.ndarray:
        """Nodes from which layer n is entered: the best of the layers above."""
        top = len(self.sizes) - 1
        if n == top:
            return np.broadcast_to(np.arange(min(self.sizes[top], 4), dtype=np.int32), (len(q), min(self.sizes[top], 4)))
        entries = _best(q @ self.v[: self.sizes[top]].T, breadth).astype(np.int32)
        for layer in range(top - 1, n, -1):
            entries = self._layer(layer, q, entries, breadth)[0]
        return entries

    def _layer(self, n: int, q: np.ndarray, entries: np.ndarray, ef: int, below: int | None = None, wide: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a layer for all queries at once: the ef best nodes found (-1 for none) and their similarities."""
        links, size = self.layers[n], self.sizes[n] if below is None else below
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, self.sizes[n] + 1), bool)
        entries = np.where(entries < size, entries, -1)
        if below is not None:
            entries = np.concatenate([entries, np.broadcast_to(np.arange(min(2, size), dtype=np.int32), (b, min(2, size)))], 1)
        seen[rows, entries] = True
        sims = np.matmul(self.v[np.maximum(entries, 0)], q[:, :, None])[:, :, 0]
        sims = np.where(entries >= 0, sims, -2.0)
        for i in range(1, entries.shape[1]):  # an entry named twice counts once
            sims[:, i] = np.where((entries[:, i : i + 1] == entries[:, :i]).any(1), -2.0, sims[:, i])
        ids = np.full((b, ef), -1, np.int32)
        near = np.full((b, ef), -2.0, np.float32)
        at = _best(sims, min(ef, sims.shape[1]))
        ids[:, : at.shape[1]], near[:, : at.shape[1]] = np.take_along_axis(entries, at, 1), np.take_along_axis(sims, at, 1)
        open_ = near > -2.0
        active = np.arange(b)
        while len(active):
            o = open_[active]
            pick = np.argsort(~o, axis=1, kind="stable")[:, :wide]
            valid = np.take_along_axis(o, pick, 1)
            some = valid.any(1)
            if not some.all():
                active, pick, valid = active[some], pick[some], valid[some]
                if not len(active):
                    break
            r = active[:, None]
            node = np.where(valid, ids[r, pick], -1)
            open_[r, pick] = False
            nb = links[np.maximum(node, 0)]
            nb = np.where(node[:, :, None] >= 0, nb, -1).reshape(len(active), -1)
            nb = np.where((nb >= 0) & (nb < size) & ~seen[r, nb], nb, -1)
            # of a node reached twice in this step one copy stays
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            seen[r, nb] = True
            which, column = np.nonzero(nb >= 0)
            node = nb[which, column]
            s = np.full(nb.shape, -2.0, np.float32)
            s[which, column] = np.einsum("ij,ij->i", self.v[node], q[active[which]])
            all_ids, all_near = np.concatenate([ids[active], nb], 1), np.concatenate([near[active], s], 1)
            all_open = np.concatenate([open_[active], s > -2.0], 1)
            at = _best(all_near, ef)
            ids[active], near[active], open_[active] = (np.take_along_axis(x, at, 1) for x in (all_ids, all_near, all_open))
        return np.where(near > -2.0, ids, -1), near

    def _thorough(self, n: int, q: np.ndarray, ef: int, below: int | None, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Search of a layer, again and broader where the similarity at ``place`` of the result is under ``loose``."""
        entries = self._entries(n, q)
        found, near = self._layer(n, q, entries, ef, below)
        weak = np.flatnonzero(near[:, place] < self.loose)
        if len(weak):
            ids, sims = self._layer(n, q[weak], entries[weak], ef * DEEPER, below)
            found[weak], near[weak] = ids[:, :ef], sims[:, :ef]
        return found, near

    def search(self, q: np.ndarray, k: int, ef: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 for none) and similarities of the k nearest nodes of each query, best first."""
        out_ids, out_sims = [np.zeros((0, k), np.int64)], [np.zeros((0, k), np.float32)]
        ef = max(k, ef)
        for a in range(0, len(q), BATCH):
            block = np.ascontiguousarray(q[a : a + BATCH], np.float32)
            if self.sizes[0] <= TOP:
                sims = block @ self.v.T
                at = _best(sims, min(k, self.sizes[0]))
                found, near = at, np.take_along_axis(sims, at, 1)
            else:
                found, near = self._thorough(0, block, ef, None, min(1, k - 1))
            found, near = found[:, :k], near[:, :k]
            short = k - found.shape[1]
            if short > 0:
                found, near = np.pad(found, ((0, 0), (0, short)), constant_values=-1), np.pad(near, ((0, 0), (0, short)), constant_values=-2.0)
            out_ids.append(np.where(found >= 0, self.ids[np.maximum(found, 0)], -1))
            out_sims.append(near)
        return np.concatenate(out_ids), np.concatenate(out_sims)
