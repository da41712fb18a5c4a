"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so the sketch is that of the item.
Items are partitioned by the number of their shingles into classes that
double; a class of at most ``u`` shingles keeps, of every item, the
``k = u - ceil(t u) + 1`` smallest values of one min-wise hash (bottom-k
MinHash).  An item with containment ``t`` or more misses at most ``k - 1``
of its shingles, so at least one sketch value is among the document's
hashes: the search loses nothing, however long the document is.
Candidates are verified by exact containment of the shingle strings.

The items are the stated query set.  They pass in blocks of at most
``BLOCK_BYTES`` of text, each against all documents; a larger benchmark
means more passes, never a larger broadcast.

Words are runs of letters, digits and non-ASCII characters after
lower-casing.  Defined results: null and empty texts have no shingles and
match nothing; a text of fewer words than a shingle has one shingle, the
whole sequence, so a very short item matches only documents of the same
words; items of equal text are one, named by the smallest id (null only if
all are); repeated document rows each get their own result rows; a null
doc_id is kept; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from salarium.llm.common import batches_of, keep_rows, ref
from salarium.llm.rolling import mixed, powers, prefix_sums

SHINGLE = 5
CONTAINMENT = 0.8
#: Text of the items that is sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: Bytes of one text that are hashed together.
PIECE = 1 << 20
#: Bits of the table that most hashes fail.
SIEVE_BITS = 20

_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
def normal(text: bytes) -> bytes:
    """Lower-cased words joined by single spaces."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    else:
        text = text.lower()
    return b" ".join(text.translate(_SEPARATORS).split())


def shingle_hashes(joined: bytes, owners: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, start, end) of every shingle of single-spaced texts that
    are joined by a space; ``owners`` are the texts' end positions.  A text
    of fewer words gives one shingle of all of them."""
    b = np.frombuffer(joined, np.uint8)
    n = len(b)
    gap = np.flatnonzero(b == 32)
    start = np.concatenate(([0], gap + 1))
    end = np.concatenate((gap, [n]))
    full = end > start
    start, end = start[full], end[full]
    owner = np.searchsorted(owners, start, side="right")
    _, down = powers(n + 1)
    sums = prefix_sums(b)
    word = mixed((sums[end] - sums[start]) * down[start])
    w = len(word)
    if w >= shingle:
        h = np.zeros(w - shingle + 1, np.uint64)
        for j in range(shingle):
            h += word[j:w - shingle + 1 + j] * np.uint64(2 * j + 3)
        whole = owner[:w - shingle + 1] == owner[shingle - 1:]
        at = np.flatnonzero(whole)
        h, o, s, e = mixed(h[at]), owner[at], start[at], end[at + shingle - 1]
    else:
        h, o, s, e = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    words = np.bincount(owner, minlength=len(owners)) if w else np.zeros(len(owners), int)
    few = np.flatnonzero((words > 0) & (words < shingle))
    if len(few):
        first = np.searchsorted(owner, few)
        sums = [sum(int(word[f + j]) * (2 * j + 3) for j in range(words[k])) & 0xFFFFFFFFFFFFFFFF for f, k in zip(first, few)]
        h = np.concatenate((h, mixed(np.array(sums, np.uint64) + np.uint64(1))))
        o = np.concatenate((o, few))
        s, e = np.concatenate((s, start[first])), np.concatenate((e, end[first + words[few] - 1]))
    return h, o, s, e


class Items:
    """A block of items: their exact shingles and the index of their
    sketches."""

    def __init__(self, ids: list, texts: list[bytes], shingle: int, containment: float):
        self.shingle, self.containment = shingle, containment
        self.ids, self.sets, self.hashes = [], [], []
        values, members = [], []
        for item, text in zip(ids, texts):
            joined = normal(text)
            if not joined:
                continue
            h, _, s, e = shingle_hashes(joined, np.array([len(joined) + 1]), shingle)
            strings = {joined[a:b] for a, b in zip(s, e)}
            h = np.unique(h)
            upper = (1 << (len(h) - 1).bit_length())
            k = upper - math.ceil(containment * upper) + 1
            sketch = h[np.argsort(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))[:k]]
            values.append(sketch)
            members.append(np.full(len(sketch), len(self.ids)))
            self.ids.append(item)
            self.sets.append(strings)
            self.hashes.append(h)
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        member = np.concatenate(members) if members else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.member = member[order]
        self.value, self.first, self.count = np.unique(value[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.value >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of every sketch value among the hashes."""
        hit = np.flatnonzero(self.sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(hit) or not len(self.value):
            return set()
        place = np.minimum(np.searchsorted(self.value, h[hit]), len(self.value) - 1)
        same = self.value[place] == h[hit]
        pairs = np.unique(np.stack((owner[hit[same]], place[same]), 1), axis=0) if same.any() else ()
        return {(int(t), int(m)) for t, p in pairs for m in self.member[self.first[p]:self.first[p] + self.count[p]]}

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, float]]]:
        """For each text the items it contains, with the exact containment."""
        found: list[list[tuple[int, float]]] = [[] for _ in texts]
        texts = [normal(t) for t in texts]
        for group, joined in self._groups(texts):
            if len(group) == 1 and len(texts[group[0]]) > PIECE:
                found[group[0]] = self._long(texts[group[0]])
                continue
            owners = np.cumsum([len(texts[i]) + 1 for i in group])
            h, o, s, e = shingle_hashes(joined, owners, self.shingle)
            pairs = sorted(self.candidates(h, o))
            if pairs:
                order = np.argsort(o, kind="stable")
                edge = np.searchsorted(o[order], np.arange(len(group) + 1))
            for t, item in pairs:
                own = order[edge[t]:edge[t + 1]]
                own = own[np.isin(h[own], self.hashes[item])]
                share = len(self.sets[item] & {joined[s[k]:e[k]] for k in own}) / len(self.sets[item])
                if share >= self.containment:
                    found[group[t]].append((item, share))
        return found

    def _groups(self, texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
        group, size = [], 0
        for i, t in enumerate(texts):
            if group and size + len(t) > PIECE:
                yield group, b" ".join(texts[k] for k in group)
                group, size = [], 0
            if t:
                group.append(i)
                size += len(t) + 1
        if group:
            yield group, b" ".join(texts[k] for k in group)

    def _long(self, text: bytes) -> list[tuple[int, float]]:
        """One long text, in pieces that overlap by a shingle less a word."""
        seen: dict[int, set[bytes]] = {}
        for verify in (False, True):
            at = 0
            while at < len(text):
                end = text.find(b" ", at + PIECE)
                end = len(text) if end < 0 else end
                piece = text[at:end]
                h, o, s, e = shingle_hashes(piece, np.array([len(piece) + 1]), self.shingle)
                if not verify:
                    seen.update({item: set() for _, item in self.candidates(h, o)})
                for item in seen if verify else ():
                    seen[item] |= self.sets[item] & {piece[s[k]:e[k]] for k in np.flatnonzero(np.isin(h, self.hashes[item]))}
                if end == len(text):
                    break
                at = end + 1
                for _ in range(self.shingle - 1):
                    at = text.rfind(b" ", 0, at - 1) + 1
        shares = ((item, len(x) / len(self.sets[item])) for item, x in sorted(seen.items()))
        return [(item, share) for item, share in shares if share >= self.containment]


def item_blocks(items: DataFrame, id_col: str, text_col: str, shingle: int, containment: float) -> Iterator[Items]:
    """Distinct items in blocks whose text fits ``BLOCK_BYTES``, cut by hash;
    one block at a time is on the driver."""
    one = (items.select(ref(items, id_col).alias("id"), ref(items, text_col).cast("string").alias("text"))
           .where(F.col("text").isNotNull()).groupBy("text").agg(F.min("id").alias("id")))
    size = one.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for k in range(n):
        rows = one.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield Items([r["id"] for r in rows], [r["text"].encode() for r in rows], shingle, containment)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
                 containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles): every document that holds
    ``containment`` or more of the shingles of a distinct item."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_id_col].dataType)
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, shingle, containment):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for at, texts in batches_of(batch.column(1)):
                    hits = [(at + i, m, share) for i, found in enumerate(block.matches(texts)) for m, share in found]
                    rows, members, shares = zip(*hits) if hits else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows, pa.int64())),
                         pa.array([block.ids[m] for m in members], item_arrow),
                         pa.array(shares, pa.float64()), pa.array([len(block.sets[m]) for m in members], pa.int32())],
                        ["doc_id", "item_id", "containment", "n_shingles"])

        part = rows.mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, containment double, n_shingles int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept, in one pass
    over the documents for each block of items."""
    for block in item_blocks(items, item_id_col, item_text_col, shingle, containment):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(texts: pa.Array, shared=shared) -> list[bool]:
            return [not found for _, part in batches_of(texts) for found in shared.value.matches(part)]

        docs = keep_rows(docs, text_col, clean)
    return docs
