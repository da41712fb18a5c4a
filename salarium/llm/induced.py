"""External induced suffix sorting with common prefixes.

The suffixes that start at local minima of the text (LMS suffixes) are
sorted first: their pieces up to the next minimum get names in text order,
and the string of names, a third of the text or less, is sorted in
memory by prefix doubling.  All other suffixes are induced: passing over the
sorted suffixes in ascending order gives the larger-type suffixes, passing
over those in descending order the smaller-type ones, because the suffix
that starts one character earlier is next in the queue of that character.

A queue of suffix tuples (position, common prefix with the tuple before)
is kept for each character.  As tuples enter in sorted order, the queue of
the smallest character is the head of one monotone priority queue.  Queues
seal blocks and put them on disk once ``budget`` tuples are in memory.
The common prefix of two tuples that enter a queue one after another is one
more than the least common prefix met between their sources, so prefixes
are carried along and the text is never compared again.

Prefixes are cut off at ``cap``; suffixes that agree on ``cap`` characters
may come in any order, which no caller can tell.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples taken from a queue at once, and put on disk at once.
BLOCK = 1 << 16
#: Below so many tuples a plain loop is faster than arrays.
SMALL = 12


class Pool:
    """Memory that all queues of one sort share, and the file behind it."""

    def __init__(self, budget: int):
        self.budget, self.held, self.file = budget, 0, None

    def store(self, pos: np.ndarray, lcp: np.ndarray):
        if self.held + len(pos) <= self.budget:
            self.held += len(pos)
            return pos, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")  # gone with the task attempt
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        return at, len(pos)

    def load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.uint32), np.frombuffer(self.file.read(n), np.uint8)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """Tuples of one character in the order of arrival."""

    def __init__(self, pool: Pool):
        self.pool, self.blocks, self.open, self.size = pool, [], [], 0

    def add(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.open.append((pos, lcp))
        self.size += len(pos)
        if self.size >= BLOCK:
            self.seal()

    def seal(self) -> None:
        if self.open:
            pos, lcp = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*self.open))
            self.blocks.append(self.pool.store(pos, lcp))
            self.open, self.size = [], 0

    def forward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order, those that arrive meanwhile included."""
        k = 0
        while True:
            if k == len(self.blocks):
                self.seal()
                if k == len(self.blocks):
                    return
            yield self.pool.load(self.blocks[k])
            k += 1

    def backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the reversed order; a prefix again is that with the
        tuple before, the first one's is 0."""
        self.seal()
        later = np.zeros(1, np.uint8)
        for block in reversed(self.blocks):
            pos, lcp = self.pool.load(block)
            yield pos[::-1], np.concatenate((later, lcp[:0:-1]))
            later = lcp[:1]


class Induction:
    """One pass: extracted tuples go in, tuples of the character before each
    go to its queue."""

    def __init__(self, text: np.ndarray, cap: int, budget: Pool, down: bool):
        self.text, self.cap, self.down = text, cap, down
        self.queues = [Queue(budget) for _ in range(256)]
        #: least prefix met since the last entry to each queue; -1 before the first, whose prefix is 0
        self.least = np.full(256, -1, np.int16)

    def take(self, pos: np.ndarray, lcp: np.ndarray, own_type: bool) -> None:
        """Induce from tuples in sorted order; ``own_type`` if they are of
        the type that this pass induces."""
        if len(pos) <= SMALL:
            for p, common in zip(pos.tolist(), lcp.tolist()):
                np.minimum(self.least, common, out=self.least)
                if p:
                    c, d = self.text[p], self.text[p - 1]
                    if (d < c if self.down else d > c) or own_type and c == d:
                        entry = min(int(self.least[d]) + 1, self.cap)
                        self.queues[d].add(np.array([p - 1], np.uint32), np.array([entry], np.uint8))
                        self.least[d] = self.cap
            return
        before = self.text[np.maximum(pos, 1) - 1]
        here = self.text[pos]
        go = (before < here) if self.down else (before > here)
        if own_type:
            go |= before == here
        go &= pos > 0
        at = np.flatnonzero(go)
        total = int(lcp.min())
        if not len(at):
            np.minimum(self.least, total, out=self.least)
            return
        to = before[at]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        entry = least_between(lcp, at).astype(np.int16)
        head, goal = np.minimum.accumulate(lcp)[at[first]], to[first]
        entry[first] = np.minimum(self.least[goal], head)
        entry = (np.minimum(entry, self.cap - 1) + 1).astype(np.uint8)
        np.minimum(self.least, total, out=self.least)
        last = at[np.concatenate((first[1:], [len(at)])) - 1]
        rest = np.concatenate((np.minimum.accumulate(lcp[::-1])[::-1], [self.cap]))
        self.least[goal] = rest[last + 1]
        new = (pos[at] - 1).astype(np.uint32)
        for k, i, j in zip(goal.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            self.queues[k].add(new[i:j], entry[i:j])


def least_between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least of values[at[k - 1] + 1 .. at[k]] for each k; where ``at`` falls
    back, anything."""
    lo = np.concatenate(([0], at[:-1] + 1))
    span = at - lo + 1
    out = values[at].copy()
    level, size = values, 1
    while True:
        wide = np.flatnonzero(span >= 2 * size)
        if not len(wide):
            return out
        level = np.minimum(level[:-size], level[size:])
        size *= 2
        out[wide] = np.minimum(level[lo[wide]], level[at[wide] - size + 1])


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, the first one the highest; ``text``
    must have eight bytes more than any position."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return view[at].astype(np.uint64)


def refine(order: np.ndarray, rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> None:
    """Sort the ``active`` elements by ``key`` inside their groups of equal
    rank; a rank is the place of its group in the order."""
    slot = np.flatnonzero(active[order])
    if not len(slot):
        return
    own = order[slot]
    if key.dtype == np.int64:  # two ranks in one word
        own = own[np.argsort(rank[own] << 32 | key[own])]
    else:
        own = own[np.lexsort((key[own], rank[own]))]
    order[slot] = own
    new = np.concatenate(([True], (rank[own][1:] != rank[own][:-1]) | (key[own][1:] != key[own][:-1])))
    group = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    rank[own] = slot[group]


def tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Elements that share their rank with another one."""
    r = rank[order]
    same = r[1:] == r[:-1]
    out = np.zeros(len(order), bool)
    out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return out


def minima(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that are local minima, the sentinel
    included."""
    start = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
    char = text[start].astype(np.int16)
    low = np.zeros(len(start), bool)
    low[1:-1] = (char[:-2] > char[1:-1]) & (char[1:-1] < char[2:])
    low[-1] = True
    length = np.diff(np.concatenate((start, [len(text)])))
    return start[low], length[low]


def sorted_minima(text: np.ndarray, padded: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order, with common prefixes."""
    at, run = minima(text)
    n, m = len(text), len(at)
    # a piece reaches over the next minimum's run and one character more: no piece is the beginning of another
    end = np.concatenate((np.minimum(at[1:] + run[1:] + 1, n), [n]))
    size = end - at
    key = words_at(padded, at)
    short = size < 8
    key[short] &= ~np.uint64(0) << ((8 - size[short]) * 8).astype(np.uint64)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    done = 8
    while done < cap:
        active = tied(order, rank) & (size > done)
        if not active.any():
            break
        key = np.zeros(m, np.uint64)
        k = np.flatnonzero(active)
        key[k] = words_at(padded, at[k] + done)
        cut = k[size[k] < done + 8]
        key[cut] &= ~np.uint64(0) << ((done + 8 - size[cut]) * 8).astype(np.uint64)
        refine(order, rank, active, key)
        done += 8
    step = 1
    while True:  # names of a piece, then of two, of four, …
        reach = np.full(m, cap, np.int64)
        if step < m:
            reach[:-step] = at[step:] - at[:-step]
        active = tied(order, rank) & (reach < cap)
        if not active.any():
            break
        key = np.zeros(m, np.int64)
        key[:-step] = rank[step:] + 1
        refine(order, rank, active, key)
        step *= 2
    pos = at[order]
    lcp = np.full(m, cap, np.int64)  # of one rank: they agree on the whole reach
    lcp[0] = 0
    live = np.flatnonzero(rank[order][1:] != rank[order][:-1]) + 1
    lcp[live] = 0
    for done in range(0, cap, 8):
        x = words_at(padded, np.minimum(pos[live] + done, n)) ^ words_at(padded, np.minimum(pos[live - 1] + done, n))
        same = np.zeros(len(live), np.int64)
        for k in range(8):
            same += x < np.uint64(1 << (8 * k))
        lcp[live] += same
        live = live[same == 8]
        if not len(live):
            break
    return pos.astype(np.uint32), np.minimum(lcp, cap).astype(np.uint8)


def common(padded: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = padded[a:a + cap], padded[b:b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def suffixes(text: np.ndarray, cap: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, prefixes) of the suffixes of ``text`` in descending order;
    a prefix is that with the suffix before.  ``text`` are bytes that end
    with the only 0; ``cap`` is at most 255."""
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    pool = Pool(budget)
    try:
        minimum, prefix = sorted_minima(text, padded, cap)
        edge = np.searchsorted(text[minimum], np.arange(257))
        up = Induction(text, cap, pool, down=False)
        for c in range(256):
            last = None
            for pos, lcp in up.queues[c].forward():
                up.take(pos, lcp, own_type=True)
                last = int(pos[-1])
            pos, lcp = minimum[edge[c]:edge[c + 1]], prefix[edge[c]:edge[c + 1]].copy()
            if len(pos):
                lcp[0] = 0 if last is None else common(padded, last, int(pos[0]), cap)
            for k in range(0, len(pos), BLOCK):
                up.take(pos[k:k + BLOCK], lcp[k:k + BLOCK], own_type=False)
        del minimum, prefix
        down = Induction(text, cap, pool, down=True)
        for c in range(255, -1, -1):
            last = None
            for pos, lcp in down.queues[c].forward():
                yield pos, lcp
                down.take(pos, lcp, own_type=True)
                last = int(pos[-1])
            for pos, lcp in up.queues[c].backward():
                if last is not None:
                    lcp = lcp.copy()
                    lcp[0] = common(padded, last, int(pos[0]), cap)
                    last = None
                yield pos, lcp
                down.take(pos, lcp, own_type=False)
    finally:
        pool.close()
