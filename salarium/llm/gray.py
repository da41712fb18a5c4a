"""A hierarchical index of 64-bit codes in Gray order.

Codes sorted by Gray rank differ in few bits from their neighbours.  The
index cuts the sorted codes into groups of ``FAN``; a group becomes a node
that holds the bits on which all its codes agree (mask and pattern), and
nodes are grouped again until one level has at most ``FAN``.  A node keeps
only the bits that its parent does not hold yet, so a search adds up the
differences on the way down and drops a whole group as soon as they exceed
the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16
#: (query, node) pairs looked at together.
CHUNK = 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary-reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index of distinct codes; positions returned by ``search`` refer to
    ``codes``, which is in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        both = either = self.codes
        full = np.full(len(self.codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        levels = [(full, self.codes)]
        while len(both) > FAN:
            starts = np.arange(0, len(both), FAN)
            both = np.bitwise_and.reduceat(both, starts)
            either = np.bitwise_or.reduceat(either, starts)
            levels.append((~(both ^ either), both))
        # from the top down: (bits that the parent does not hold, pattern)
        self.levels = []
        for k in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[k]
            if k + 1 < len(levels):
                mask = mask & ~np.repeat(levels[k + 1][0], FAN)[:len(mask)]
            self.levels.append((mask, pattern))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (query position, code position) for every pair that
        differs in at most ``limit`` bits."""
        if not len(queries) or not len(self.codes):
            return
        top = len(self.levels[0][0])
        step = max(1, CHUNK // top)
        for at in range(0, len(queries), step):
            q = np.repeat(np.arange(at, min(at + step, len(queries))), top)
            n = np.tile(np.arange(top), len(q) // top)
            yield from self._down(queries, q, n, np.zeros(len(q), np.uint8), 0, limit)

    def _down(self, queries, q, node, sofar, level, limit):
        mask, pattern = self.levels[level]
        sofar = sofar + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        keep = sofar <= limit
        q, node, sofar = q[keep], node[keep], sofar[keep]
        if not len(q):
            return
        if level + 1 == len(self.levels):
            yield q, node
            return
        size = len(self.levels[level + 1][0])
        for at in range(0, len(q), CHUNK // FAN):
            part = slice(at, at + CHUNK // FAN)
            child = (node[part, None] * FAN + np.arange(FAN)).ravel()
            inside = child < size
            yield from self._down(queries, np.repeat(q[part], FAN)[inside], child[inside],
                                  np.repeat(sofar[part], FAN)[inside], level + 1, limit)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of ``n`` positions is linked to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(root[a], root[b])
            if np.array_equal(root[a], low) and np.array_equal(root[b], low):
                break
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root[root], root):
                root = root[root]
    return root
