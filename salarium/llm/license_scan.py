"""License scan by patience alignment.

A text and a template are aligned on the words that occur once in both: the
longest run of such anchors in increasing order holds, and the gaps between
them are aligned in the same way.  The aligned share of the template's words
is its coverage; where repeated words leave patience short of ``COVERAGE``,
that of the longest common subsequence.

A place is a stretch of at most twice the template's length that holds
``COVERAGE`` of its words in order.  Places are disjoint and as many as can
be: a sliding count of shared words says where one may start, a bit-parallel
common subsequence where it ends.  Each document is read once, whole, and
nothing leaves its row.

Defined results: words are runs of letters and digits after lower-casing;
null and empty texts match nothing; a template found several times gives one
row, the place of the best coverage, the first of equals, and the number of
places; of templates that meet in one place the one with most aligned words
has it; repeated rows each give their own; a null id is kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from salarium.llm.common import ref
from salarium.llm.license_texts import TEMPLATES

COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+")


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before[i] = piles[p - 1] if p else -1
        piles[p:p + 1] = [i]
        tops[p:p + 1] = [v]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, both increasing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_b = {w: None for w, n in Counter(b[k:m]).items() if n == 1}
        once_b.update({b[x]: x for x in range(k, m) if b[x] in once_b})
        count = Counter(a[i:j])
        anchors = [(x, once_b[a[x]]) for x in range(i, j) if count[a[x]] == 1 and a[x] in once_b]
        chain = [anchors[x] for x in increasing([y for _, y in anchors])]
        if chain:
            out.extend(chain)
            edges = [(i - 1, k - 1), *chain, (j, m)]
            todo.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        self.words = [m[0] for m in WORDS.finditer(text.lower())]
        self.count = Counter(self.words)
        self.known = frozenset(self.words)
        self.need = math.ceil(len(self.words) * COVERAGE - 1e-9)
        self.reach = 2 * len(self.words)
        #: different words that any place has: each word that is missing lacks at least one position
        self.least = max(1, len(self.known) - (len(self.words) - self.need))
        self.masks, self.back = ({}, {})
        for masks, order in ((self.masks, self.words), (self.back, self.words[::-1])):
            for i, w in enumerate(order):
                masks[w] = masks.get(w, 0) | 1 << i

    def common(self, words: list[str], path: range, goal: int) -> tuple[int, int]:
        """Longest common subsequence of the template and the words along
        ``path`` (backwards: of both from behind), bit-parallel, up to
        ``goal``; and the last position that added to it."""
        masks = self.masks if path.step > 0 else self.back
        n = len(self.words)
        every = (1 << n) - 1
        row, length, last = every, 0, -1
        for p in path:
            m = masks.get(words[p])
            if m is None:
                continue
            u = row & m
            row = ((row + u) | (row - u)) & every
            now = n - row.bit_count()
            if now > length:
                length, last = now, p
                if length >= goal:
                    break
        return length, last

    def starts(self, words: list[str], at: list[int]) -> Iterator[int]:
        """Known words from which a stretch in reach holds as many words of
        the template, in any order, as a place needs."""
        seen, shared, right = Counter(), 0, 0
        for p in at:
            while right < len(at) and at[right] < p + self.reach:
                w = words[at[right]]
                shared += seen[w] < self.count[w]
                seen[w] += 1
                right += 1
            if shared >= self.need:
                yield p
            seen[words[p]] -= 1
            shared -= seen[words[p]] < self.count[words[p]]

    def places(self, words: list[str], at: list[int]) -> list[tuple[int, int]]:
        """The largest number of disjoint stretches, at most ``reach`` words
        long, that hold ``need`` words of the template in order: always the
        one that ends first, from the last word where it can start; ``at``
        are the positions of known words."""
        out, free = [], 0
        for p in self.starts(words, at):
            if p < free:
                continue
            length, last = self.common(words, range(p, min(len(words), p + self.reach)), self.need)
            if length < self.need:
                free = p + self.need - length  # a start further right by one gains at most one word
                continue
            _, first = self.common(words, range(last, p - 1, -1), self.need)
            out.append((first, last + 1))
            free = last + 1
        return out

    def found(self, words: list[str], at: list[int]) -> list[tuple[int, int, int]]:
        """(aligned words, first word, last word) of every place, carried on
        as far as its neighbours and ``reach`` let it."""
        out, places = [], self.places(words, at)
        before = 0
        for (start, end), (limit, _) in zip(places, [*places[1:], (len(words), 0)]):
            whole = len(self.words)
            wide = max(before, end - self.reach)
            length, first, last = 0, 0, 0
            for s in {start: 0, wide: 0}:
                n, e = self.common(words, range(s, min(limit, s + self.reach)), whole)
                if n > length:
                    length, last = n, e
                    _, first = self.common(words, range(e, s - 1, -1), n)
            aligned = len(align(words[first:last + 1], self.words))
            out.append((aligned if aligned >= self.need else length, first, last))
            before = last + 1
        return out

    def find(self, words: list[str], at: list[int]) -> tuple[float, int, int, int] | None:
        """(coverage, first word, last word, places) of the best place."""
        found = self.found(words, at)
        if not found:
            return None
        n, first, last = max(found, key=lambda x: (x[0], -x[1]))
        return n / len(self.words), first, last, len(found)


def choose(hits: list[Template], words: list[str]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first word, last word, places) of the templates
    found; of places that overlap by over half of the shorter the one with
    more aligned words counts, of equals the better covered."""
    places = [(-n, -n / len(t.words), first, last, t.name) for t in hits
              for n, first, last in t.found(words, [k for k, w in enumerate(words) if w in t.known])]
    taken, out = bytearray(len(words)), {}
    for _, share, first, last, name in sorted(places):
        size = last + 1 - first
        if 2 * taken.count(1, first, last + 1) <= size:
            taken[first:last + 1] = b"\1" * size
            out.setdefault(name, []).append((share, first, last))
    return [(t.name, -min(out[t.name])[0], *min(out[t.name])[1:], len(out[t.name])) for t in hits if t.name in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, start, end, places): licenses found in
    every document; start and end are code points, the end exclusive."""
    known = templates or TEMPLATES
    rows = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of = [Template(n, t) for n, t in known.items()]
        vocabulary = frozenset().union(*(t.known for t in all_of))
        for b in batches:
            place, found = [], []
            for i, value in enumerate(b.column(1)):
                text = value.as_py() or ""
                words = WORDS.findall(text.lower())
                here = vocabulary.intersection(words)
                hits = [t for t in all_of if len(here) >= t.least and len(words) >= t.need and len(t.known & here) >= t.least]
                if not hits:
                    continue
                # lower-casing may change the length, so positions come from the text as it is
                spans = [(m.start(), m.end()) for m in WORDS.finditer(text)]
                words = [text[s:e].lower() for s, e in spans]
                for name, share, first, last, places in choose(hits, words):
                    place.append(i)
                    found.append((name, share, spans[first][0], spans[last][1], places))
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc_id", "license", "coverage", "start", "end", "places"])

    return rows.mapInArrow(run, f"doc_id {kind}, license string, coverage double, start int, end int, places int")
