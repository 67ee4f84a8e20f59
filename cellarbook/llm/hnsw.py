"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at once.

Nodes are ordered by level, so layer l holds the first `sizes[l]` nodes and its links are one array of
neighbour numbers (-1: none). A search walks down the layers and keeps a beam on the lowest one.
"""

from __future__ import annotations

import numpy as np

LINKS = 12  # neighbours that a node chooses in upper layers; twice as many in the lowest layer
SLACK = 8  # further neighbours that may choose it before its own choice is made again
BEAM_BUILD = 40
TOGETHER = 256  # vectors that are searched or put in at once
WIDE = 4  # nodes of a beam that are opened in one step


def _search(vectors, links, queries, entry, beam):
    """(ids, similarities) of the `beam` best nodes found from `entry` (one node per query), best first."""
    n, q = len(vectors), len(queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n), bool)
    seen[rows, entry[:, None]] = True
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", queries, vectors[entry])
    open_ = np.zeros((q, beam), bool)
    open_[:, 0] = True
    live = np.arange(q)
    while len(live):
        r = rows[: len(live)]
        waiting = np.where(open_[live], sims[live], -np.inf)
        width = min(WIDE, beam)
        best = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(live), 1))
        good = np.isfinite(np.take_along_axis(waiting, best, 1))
        open_[live[:, None], best] = False
        chosen = np.where(good, ids[live[:, None], best], -1)
        near = links[np.maximum(chosen, 0)]
        near[chosen < 0] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], np.maximum(near, 0)]
        x, y = np.nonzero(fresh)
        found = near[x, y]
        seen[live[x], found] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[x, y] = np.einsum("kd,kd->k", queries[live[x]], vectors[found])
        all_sims, all_ids = np.concatenate([sims[live], new], 1), np.concatenate([ids[live], near], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live] = all_sims[r, top], all_ids[r, top]
        open_[live] = all_open[r, top]
        live = live[open_[live].any(1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(vectors, candidates, sims, most):
    """Per row, candidates in order of similarity that are closer to the node than to those already taken."""
    q, width = candidates.shape
    near = vectors[np.maximum(candidates, 0)]
    between = np.einsum("qid,qjd->qij", near, near)
    taken = np.zeros((q, width), bool)
    count = np.zeros(q, int)
    for j in range(width):
        rival = np.where(taken, between[:, j], -np.inf).max(1)
        ok = (candidates[:, j] >= 0) & np.isfinite(sims[:, j]) & (rival < sims[:, j]) & (count < most)
        taken[:, j] = ok
        count += ok
    for j in range(width):  # room that is left goes to the closest others
        ok = (candidates[:, j] >= 0) & np.isfinite(sims[:, j]) & ~taken[:, j] & (count < most)
        taken[:, j] |= ok
        count += ok
    out = np.full((q, most), -1, np.int32)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    picked = np.take_along_axis(candidates, order, 1)
    picked[~np.take_along_axis(taken, order, 1)] = -1
    out[:, : picked.shape[1]] = picked
    return out


class Hnsw:
    """`order` gives the caller's row of each node."""

    def __init__(self, order: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]):
        self.order, self.vectors, self.layers = order, vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Hnsw:
        """Graph over rows of unit vectors (float32)."""
        n = len(vectors)
        level = np.floor(-np.log(np.random.Generator(np.random.PCG64(seed)).random(n) + 1e-12) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        sizes = [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]
        own = cls(order, np.ascontiguousarray(vectors[order], np.float32), [])
        for size in reversed(sizes):  # the highest layer first
            own.layers.append(own._layer(size, 2 * LINKS if size == n else LINKS))
        return own

    def _layer(self, size: int, most: int) -> np.ndarray:
        v, links = self.vectors, np.full((size, most + SLACK), -1, np.int32)
        used = np.zeros(size, np.int64)
        start = 0
        while start < size:
            stop = min(size, start + min(TOGETHER, max(1, start)))
            batch = v[start:stop]
            inside = batch @ batch.T
            np.fill_diagonal(inside, -np.inf)
            # Vectors that come in together may be each other's neighbours.
            width = min(most, stop - start)
            near = np.argsort(-inside, axis=1)[:, :width]
            ids, sims = near + start, np.take_along_axis(inside, near, 1)
            if start:
                entry = self._enter(batch, start)
                found, found_sims = _search(v[:start], links[:start], batch, entry, BEAM_BUILD)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, found_sims], 1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM_BUILD]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            links[start:stop, :most] = _diverse(v, ids, sims, most)
            used[start:stop] = (links[start:stop] >= 0).sum(1)
            self._link_back(links, used, start, stop, most)
            start = stop
        return links

    def _link_back(self, links: np.ndarray, used: np.ndarray, start: int, stop: int, most: int) -> None:
        """Links from the neighbours of new nodes; a node without room chooses its neighbours again."""
        source = np.repeat(np.arange(start, stop), most)
        target = links[start:stop, :most].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = used[target] + np.arange(len(target)) - np.repeat(first, counts)
        room = np.repeat(used[nodes] + counts <= links.shape[1], counts)
        links[target[room], place[room]] = source[room]
        used[target[room]] = place[room] + 1  # the last one of a node counts
        full = np.flatnonzero(used[nodes] + counts > links.shape[1])
        for some in (full[i : i + 512] for i in range(0, len(full), 512)):
            every = np.full((len(some), links.shape[1] + int(counts[some].max())), -1, np.int32)
            every[:, : links.shape[1]] = links[nodes[some]]
            for i, x in enumerate(some):
                every[i, links.shape[1] : links.shape[1] + counts[x]] = source[first[x] : first[x] + counts[x]]
            sims = np.einsum("qd,qkd->qk", self.vectors[nodes[some]], self.vectors[np.maximum(every, 0)])
            sims[every < 0] = -np.inf
            top = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            every, sims = np.take_along_axis(every, top, 1), np.take_along_axis(sims, top, 1)
            links[nodes[some]] = -1
            links[nodes[some], :most] = _diverse(self.vectors, every, sims, most)
            used[nodes[some]] = (links[nodes[some]] >= 0).sum(1)

    def _enter(self, queries: np.ndarray, below: int) -> np.ndarray:
        """Nearest node of the layers built so far, among nodes before `below`."""
        entry = np.zeros(len(queries), np.int64)
        for links in self.layers:
            size = len(links)
            ids, _ = _search(self.vectors[:size], links, queries, np.minimum(entry, size - 1), 2)
            entry = ids[:, 0].astype(np.int64)
        return np.where(entry < below, entry, 0)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the `beam` best found for each query; row -1 where there are fewer."""
        queries = np.ascontiguousarray(queries, np.float32)
        if not len(self.vectors) or not len(queries):
            return np.full((len(queries), beam), -1), np.full((len(queries), beam), -np.inf, np.float32)
        beam = min(beam, len(self.vectors))
        out = []
        for low in range(0, len(queries), TOGETHER):
            some = queries[low : low + TOGETHER]
            entry = np.zeros(len(some), np.int64)
            for links in self.layers[:-1]:
                size = len(links)
                entry = _search(self.vectors[:size], links, some, entry, 2)[0][:, 0].astype(np.int64)
            ids, sims = _search(self.vectors, self.layers[-1], some, entry, beam)
            out.append((np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def blob(self) -> list[bytes]:
        """Order and layers as bytes; the vectors are kept by the caller."""
        return [self.order.astype("<i8").tobytes(), *(x.astype("<i4").tobytes() for x in self.layers)]

    @classmethod
    def opened(cls, vectors: np.ndarray, blob: list[bytes]) -> Hnsw:
        order = np.frombuffer(blob[0], "<i8")
        layers = [np.frombuffer(x, "<i4").reshape(-1, LINKS + SLACK) for x in blob[1:-1]]
        layers.append(np.frombuffer(blob[-1], "<i4").reshape(len(order), -1))
        return cls(order, np.ascontiguousarray(vectors[order], np.float32), layers)
