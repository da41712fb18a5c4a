"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprint every document: a bit is 1 if it is set in over half of the
   XXH64 hashes of its word shingles.  Equal fingerprints collapse to one
   row, so a hot group of copies is one code.
2. Sort the distinct fingerprints by Gray rank and cut the order into
   ``RANGES`` ranges, more only if one would exceed ``RANGE_CODES`` codes,
   at most ``MAX_RANGES``.  The agreed bits of a range are an upper node of the index; the driver holds
   these nodes alone, two longs each.
3. A fingerprint visits the ranges whose upper node it differs from in at
   most the allowed bits; of two ranges one is visited, taken in turns, so
   each pair of codes meets once.  A range is one group, searched with its
   index; it returns links of a spanning forest, never all its pairs.
4. Components of the links give every document its class.

Defined results: null and empty text have fingerprint zero and are linked
like any other; fewer words than the shingle length make one shingle of
the whole sequence; a null id keeps its row and names a class only if every
id of the class is null; repeated rows are separate rows of one class; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salarium.llm.common import fresh, ref
from salarium.llm.components import connected_components
from salarium.llm.gray import GrayIndex, forest, gray_rank
from salarium.session import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Ranges of the Gray order: so many, more if a range would exceed RANGE_CODES, never over MAX_RANGES.
RANGES = 64
RANGE_CODES = 1 << 21
MAX_RANGES = 4096
#: Shingles of one text that are hashed together.
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text, A-Z lower-cased, words cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    last = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at:at + PIECE], last[at:at + PIECE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code) of every row; code is the fingerprint as a signed long."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1)),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, code long")


def ranges(codes: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Cut points of the Gray order and the mask and pattern of each range;
    at most MAX_RANGES of each reach the driver."""
    n = codes.count()
    parts = max(1, min(n, MAX_RANGES, max(RANGES, -(-n // RANGE_CODES))))
    cuts: list[int] = []
    if parts > 1:
        points = [i / parts for i in range(1, parts)]
        found = codes.agg(F.percentile_approx("rank", points, 100 * parts).alias("p")).first()["p"]
        cuts = sorted(set(found))
    at = np.array(cuts, np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(at, r, side="left"), pa.int32())], ["code", "part"])

    nodes = (codes.select("code", "rank").mapInArrow(number, "code long, part int").groupBy("part")
             .agg(F.bit_and("code").alias("both"), F.bit_or("code").alias("either")).collect())
    mask, pattern = np.zeros(len(cuts) + 1, np.uint64), np.full(len(cuts) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    empty = np.ones(len(cuts) + 1, bool)
    for r in nodes:
        both, either = np.array([r["both"], r["either"]], np.int64).view(np.uint64)
        mask[r["part"]], pattern[r["part"]], empty[r["part"]] = ~(both ^ either), both, False
    return cuts, np.where(empty, np.uint64(0xFFFFFFFFFFFFFFFF), mask), pattern


def links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between distinct codes at ``max_bits`` or fewer
    differing bits: enough of them to keep every connection."""
    cuts, mask, pattern = ranges(codes)
    places = np.arange(len(mask))
    at, step = np.array(cuts, np.int64), max(1, (1 << 22) // len(mask))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy(zero_copy_only=False)
            home = np.searchsorted(at, b.column(1).to_numpy(zero_copy_only=False), side="left")
            for i in range(0, len(code), step):
                c, own = code[i:i + step], home[i:i + step]
                near = np.bitwise_count((c.view(np.uint64)[:, None] ^ pattern) & mask) <= max_bits
                turn = (own[:, None] + places) % 2 == 0
                near &= np.where(own[:, None] < places, turn, ~turn)
                near[np.arange(len(c)), own] = True
                k, part = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(part != own[k]), pa.array(c[k])],
                                                 ["part", "visits", "code"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, visits = pdf["code"].to_numpy().view(np.uint64), pdf["visits"].to_numpy(bool)
        index, others = GrayIndex(codes[~visits]), codes[visits]
        every = np.concatenate([index.codes, others])
        pairs = index.search(every, max_bits)
        root = forest(len(every), pairs)
        child = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"u": every[child].view(np.int64), "v": every[root[child]].view(np.int64)})

    routed = codes.select("code", "rank").mapInArrow(route, "part int, visits boolean, code long")
    return routed.groupBy("part").applyInPandas(search, "u long, v long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(code, component_id) of every distinct code among (doc_id, code):
    the smallest id reachable over links."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = gray_rank(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            # the signed order of the flipped top bit is the unsigned order
            rank = (rank ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rank)], ["code", "least", "rank"])

    least = prints.groupBy("code").agg(F.min("doc_id").alias("least"))
    kind = least.schema["least"].dataType.simpleString()
    codes = materialize(least.mapInArrow(ranked, f"code long, least {kind}, rank long"))
    roots = connected_components(links(codes, max_bits))
    named = codes.select("code", "least").join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "least", F.coalesce("root", "code").alias("root"))
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(label, "root").select("code", "component_id")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    named = classes(prints, max_bits)
    return prints.join(named, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class: that of the smallest id, by the smallest text
    hash and scan position among equal ids; all columns kept.

    ``docs`` must be a table read (its scan positions tell equal rows apart).
    """
    at, = fresh(docs, "position")
    place = docs.withColumn(at, F.monotonically_increasing_id())
    spot = F.struct(ref(place, id_col).isNull().alias("no_id"), ref(place, id_col).alias("id"),
                    F.md5(F.coalesce(ref(place, text_col).cast("string"), F.lit(""))).alias("text"), F.col(at).alias("at"))
    prints = materialize(fingerprints(place.withColumn(id_col, spot), id_col, text_col, shingle))
    winners = classes(prints, max_bits).select(F.col("component_id.at").alias("w")).distinct()
    return place.join(winners, F.col(at) == F.col("w"), "left_semi").drop(at)
