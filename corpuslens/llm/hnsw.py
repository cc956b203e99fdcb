"""A hierarchical navigable small-world graph over unit vectors, built and searched by batches of NumPy arrays.

Nodes of the graph are leaders: a vector within half of the linking angle of one that is there already joins its ball
instead. Members of a ball are all linked with one another (the angles to the leader add up to the linking angle at
most), so groups of near copies neither crowd the graph nor are compared pair by pair to know their component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Neighbours of a node on an upper level; twice as many on the base level.
DEGREE = 12
#: Beam of the build, and the first beam of searches.
BUILD_BEAM, FIRST_BEAM = 48, 24
#: Most nodes that are added, and most bytes of marks of queries that are answered, at once.
BATCH, MARK_BYTES = 512, 16 << 20
#: A search is audited with so many nodes; the beam is doubled until this share of what they should find is found.
AUDITED, AUDIT_RECALL = 256, 0.995
#: float32 products are off by less.
SLACK = 1e-5


def half_angle(threshold: float) -> float:
    """Cosine of half the angle whose cosine is the threshold."""
    return math.sqrt((1 + threshold) / 2)


def plus_half(threshold: float) -> float:
    """Cosine of one and a half times the angle whose cosine is the threshold."""
    return math.cos(min(math.pi, 1.5 * math.acos(threshold)))


def drawn_levels(numbers: np.ndarray) -> np.ndarray:
    """Level of each node, from a 64-bit random number of its own: each level has about a DEGREE-th of the one below."""
    u = (numbers.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(-np.log(np.maximum(u, 2.0**-53)) / math.log(DEGREE), 12).astype(np.int64)


def widest(products: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in no order."""
    return np.argpartition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k :] if products.shape[1] > k else np.broadcast_to(np.arange(products.shape[1]), products.shape)


class Graph:
    """vectors: float32, n x d, of length 1; only the first size of them are in the graph. near[l]: neighbours on level l, -1 for none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, near: list[np.ndarray] | None = None, entry: int = -1, size: int = 0, beam: int = FIRST_BEAM):
        self.vectors, self.levels, self.entry, self.size, self.beam = vectors, levels, entry, size, beam
        top = int(levels.max(initial=0))
        self.near = near if near is not None else [np.full((len(vectors), DEGREE * (1 if level else 2)), -1, np.int32) for level in range(top + 1)]

    # searching

    def walk(self, q: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk from a start node per query: the width best nodes met, -1 (product -inf) where fewer; in no order."""
        near, n = self.near[level], len(q)
        seen = np.zeros((n, self.size), bool)
        ids, products, fresh = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, 0], products[:, 0], fresh[:, 0] = start, np.einsum("ij,ij->i", q, self.vectors[start]), True
        rows = np.arange(n)
        seen[rows, start] = True
        while True:
            waiting = np.where(fresh[rows], products[rows], -np.inf)
            best = waiting.argmax(1)
            going = waiting[np.arange(len(rows)), best] > -np.inf
            rows, best = rows[going], best[going]
            if not len(rows):
                return ids, products
            fresh[rows, best] = False
            around = near[ids[rows, best]]
            new = around >= 0
            new &= ~seen[rows[:, None], around]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            to, who = around[r, c], rows[r]
            seen[who, to] = True
            met = np.full(around.shape, -np.inf, np.float32)
            met[r, c] = np.einsum("ij,ij->i", q[who], self.vectors[to])
            # rows that met nothing better than their worst have nothing to merge
            better = met.max(1) > products[rows].min(1)
            rows_b = rows[better]
            if not len(rows_b):
                continue
            every = np.concatenate([products[rows_b], met[better]], 1)
            keep = widest(every, width)
            products[rows_b] = np.take_along_axis(every, keep, 1)
            ids[rows_b] = np.take_along_axis(np.concatenate([ids[rows_b], around[better]], 1), keep, 1)
            fresh[rows_b] = np.take_along_axis(np.concatenate([fresh[rows_b], np.ones((len(rows_b), around.shape[1]), bool)], 1), keep, 1) & (products[rows_b] > -np.inf)

    def down_to(self, q: np.ndarray, level: int) -> np.ndarray:
        """A start node per query for a level: the best that walks of the levels above find."""
        start = np.full(len(q), self.entry, np.int32)
        for upper in range(len(self.near) - 1, level, -1):
            if self.levels[self.entry] >= upper:
                start = self.walk(q, start, 1, upper)[0][:, 0]
        return start

    def batches(self, n: int) -> Iterator[slice]:
        step = max(32, min(1024, MARK_BYTES // max(1, self.size)))
        return (slice(a, min(a + step, n)) for a in range(0, n, step))

    def within(self, q: np.ndarray, least: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a product of at least so much. A query whose whole beam passes goes on with a wider one, at last with all nodes."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if self.size:
            for part in self.batches(len(q)):
                rows, width = np.arange(part.start, part.stop), beam or self.beam
                start = self.down_to(q[rows], 0)
                while len(rows):
                    if 4 * width >= self.size:
                        r, ids = np.nonzero(q[rows] @ self.vectors[: self.size].T >= least)
                        found.append((rows[r], ids))
                        break
                    ids, products = self.walk(q[rows], start, width, 0)
                    full = products.min(1) >= least
                    r, c = np.nonzero((products >= least) & ~full[:, None])
                    found.append((rows[r], ids[r, c]))
                    rows, start, width = rows[full], start[full], 4 * width
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def audit(self, threshold: float, least: float, seed: np.ndarray, recall: float = AUDIT_RECALL) -> list[tuple[int, float]]:
        """Widen the beam until searches find the given share of what an exact comparison finds; the beams tried and their shares.

        Searched are nodes (in the order of seed, a random number each) as they are, and moved away from themselves just
        as far as a link may reach, so that there is something to find at the threshold whatever the data.
        """
        tried: list[tuple[int, float]] = []
        n = self.size
        if n == 0:
            return tried
        picked = np.argsort(seed[:n], kind="stable")[:AUDITED]
        own = self.vectors[picked]
        aside = np.random.default_rng(5).standard_normal(own.shape).astype(np.float32)
        aside -= np.einsum("ij,ij->i", aside, own)[:, None] * own
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        cosine = min(1.0, threshold + 1e-3)
        q = np.concatenate([own, cosine * own + math.sqrt(1 - cosine**2) * aside]).astype(np.float32)
        hits = np.flatnonzero((q @ self.vectors[:n].T >= least).reshape(-1))
        while True:
            r, ids = self.within(q, least)
            share = len(np.intersect1d(r * n + ids, hits)) / max(1, len(hits))
            tried.append((self.beam, share))
            if share >= recall or 4 * self.beam >= n:
                return tried
            self.beam *= 2

    # building

    def chosen(self, own: np.ndarray, ids: np.ndarray, products: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates, up to m: first those nearer to the row than to any taken before them, then the nearest others. -1 for none."""
        order = np.argsort(-products, axis=1, kind="stable")[:, : 3 * m]
        ids, products = np.take_along_axis(ids, order, 1), np.take_along_axis(products, order, 1)
        there = products > -np.inf
        vectors = self.vectors[np.maximum(ids, 0)]
        mutual = np.matmul(vectors, vectors.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for i in range(ids.shape[1]):
            shaded = (taken[:, :i] & (mutual[:, i, :i] > products[:, i : i + 1])).any(1)
            taken[:, i] = there[:, i] & ~shaded
        rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.concatenate([out, np.full((len(out), m - out.shape[1]), -1, out.dtype)], 1) if out.shape[1] < m else out

    def add(self, q: np.ndarray, starts: np.ndarray) -> None:
        """The next len(q) nodes join the graph; starts: their start nodes on the base level."""
        first, n = self.size, len(q)
        new = np.arange(first, first + n)
        self.vectors[new] = q
        levels = self.levels[new]
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        found = []
        for level in range(int(levels.max(initial=0)) + 1):
            rows = np.flatnonzero(levels >= level)
            ids, products = np.zeros((len(rows), 0), np.int32), np.zeros((len(rows), 0), np.float32)
            if first and self.levels[self.entry] >= level:
                ids, products = self.walk(q[rows], starts[rows] if level == 0 else self.down_to(q[rows], level), BUILD_BEAM, level)
            mates = mutual[np.ix_(rows, rows)]
            at = widest(mates, BUILD_BEAM)
            found.append((new[rows], q[rows], np.concatenate([ids, new[rows][at]], 1), np.concatenate([products, np.take_along_axis(mates, at, 1)], 1)))
        for level, (ends, own, ids, products) in enumerate(found):
            self.near[level][ends] = self.chosen(own, ids, products, self.near[level].shape[1])
            self._back(level, ends)
        self.size += n
        top = new[levels.argmax()]
        if self.entry < 0 or self.levels[top] > self.levels[self.entry]:
            self.entry = int(top)

    def _back(self, level: int, new: np.ndarray) -> None:
        """Neighbours of new nodes get them as neighbours, too, and choose anew where they have too many."""
        near = self.near[level]
        m = near.shape[1]
        r, c = np.nonzero(near[new] >= 0)
        source, target = new[r], near[new][r, c]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(heads, len(target)))
        nth = np.arange(len(target)) - np.repeat(heads, counts)
        # rounds of up to m sources a target, so that rows stay narrow at hubs
        for k in range(int(nth.max(initial=-1)) // m + 1):
            some = nth // m == k
            ends, row = np.unique(target[some], return_inverse=True)
            for part in range(0, len(ends), 4 * BATCH):
                rows = np.arange(part, min(part + 4 * BATCH, len(ends)))
                mine = (row >= rows[0]) & (row <= rows[-1])
                ids = np.concatenate([near[ends[rows]], np.full((len(rows), m), -1, np.int32)], 1)
                ids[row[mine] - part, m + nth[some][mine] % m] = source[some][mine]
                # one that is on both lists (a mate of the same batch) counts once
                old = ids[:, :m]
                twice = (ids[:, m:, None] == old[:, None, :]).any(2)
                ids[:, m:][twice] = -1
                own = self.vectors[ends[rows]]
                products = np.where(ids >= 0, np.einsum("ij,ikj->ik", own, self.vectors[np.maximum(ids, 0)]), -np.inf).astype(np.float32)
                near[ends[rows]] = self.chosen(own, ids, products, m)


def build(vectors: np.ndarray, numbers: np.ndarray, threshold: float) -> tuple[Graph, np.ndarray]:
    """The graph of leaders of unit vectors, and for each vector its leader (a node of the graph). numbers: a random 64-bit number each."""
    n, near_enough = len(vectors), half_angle(threshold) + SLACK
    own = vectors.astype(np.float32)
    drawn = drawn_levels(numbers)
    graph = Graph(np.zeros_like(own), drawn)
    graph.levels = np.zeros(n, np.int64)
    leader, at = np.full(n, -1, np.int64), 0
    while at < n:
        size = min(BATCH, max(16, graph.size), n - at)
        rows = np.arange(at, at + size)
        q, at = own[rows], at + size
        starts = np.zeros(size, np.int32)
        if graph.size:
            ids, products = graph.walk(q, graph.down_to(q, 0), max(8, FIRST_BEAM // 2), 0)
            best = products.argmax(1)
            starts = ids[np.arange(size), best]
            joins = products[np.arange(size), best] >= near_enough
            leader[rows[joins]] = starts[joins]
            rows, q, starts = rows[~joins], q[~joins], starts[~joins]
        mutual = q @ q.T >= near_enough
        of = np.full(len(rows), -1, np.int64)
        leads = []
        for i in range(len(rows)):
            if of[i] < 0:
                of[(of < 0) & mutual[i]] = len(leads)
                of[i] = len(leads)
                leads.append(i)
        leader[rows] = graph.size + of
        graph.levels[graph.size : graph.size + len(leads)] = drawn[rows[leads]]
        if leads:
            graph.add(q[leads], starts[leads])
    graph.vectors, graph.levels = graph.vectors[: graph.size].copy(), graph.levels[: graph.size].copy()
    graph.near = [x[: graph.size].copy() for x in graph.near]
    return graph, leader
