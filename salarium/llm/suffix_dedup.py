"""Removal of repeated substrings by external suffix sorting.

Every byte goes that is covered by a string of ``length`` bytes that also
starts anywhere else in the corpus; matches never cross documents.

Sharding.  Each window of ``length`` bytes is assigned to its anchor, the
gram of least hash inside it; neighbouring windows with one anchor are a
run.  Equal windows have equal anchors, so they meet in the shard of the
anchor's hash, wherever they are, and a run whose anchor occurs once has no
repeat.  Runs are light rows (hashes, place); equal runs collapse to one row
with a count before any text moves, so copies and common passages travel
once.

Sorting.  Runs that share an anchor but differ are cut from their documents
and sorted by suffix (``induced.py``).  A shard is any number of anchors: it
is read as a stream, and each time the anchors at hand reach ``SORT_BYTES``
they are sorted, so a shard may be far larger than memory.  Neighbours of
the suffix order that share ``length`` bytes mark their windows.

An anchor with more than ``HOT_RUNS`` different runs is not sorted in one
place: its windows are counted by a 128-bit hash, spread over all tasks.

Identity of documents and runs is a 128-bit hash of their bytes.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; equal texts of at least ``length`` bytes lose everything, as each
repeats the other; repeated rows, null ids and equal ids each keep a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salarium.llm.common import batches_of, ref
from salarium.llm.induced import suffixes
from salarium.llm.rolling import mixed, powers, prefix_sums

LENGTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Bytes whose runs are found together.
PIECE = 1 << 17
#: Bytes that are sorted together, and suffix tuples held in memory.
SORT_BYTES = 4 << 20
TUPLES = 2 << 20
HOT_RUNS = 50_000

_PLACE = np.uint64((1 << 24) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n = len(values)
    full = -(-n // width) * width
    blocks = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, windows, anchor hash, run hash) of the runs of texts
    that lie one after another; ``ends`` are their ends."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    _, down = powers(n + 1)
    sums = prefix_sums(data)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    # the place breaks ties to the left, and tells the places of equal grams apart
    anchor = (sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    # windows that reach over the end of a text are none
    whole = np.ones(n, bool)
    for end in ends.tolist():
        whole[max(0, end - length + 1):end] = False
    inside = np.flatnonzero(whole[:len(anchor)])
    if not len(inside):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    own = anchor[inside]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1))))
    lo = inside[first]
    windows = np.diff(np.concatenate((first, [len(own)])))
    hi = lo + windows - 1 + length
    run = mixed((sums[hi] - sums[lo]) * down[lo] + windows.astype(np.uint64))
    text = np.searchsorted(ends, lo, side="right")
    return text, lo - np.concatenate(([0], ends))[text], windows, grams[own[first]], run


def text_runs(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole texts: short ones together, a long one in pieces that
    share the windows' reach."""
    group, size = [], 0

    def together() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        text, *rest = runs(data, np.cumsum([len(texts[i]) for i in group]), length, gram)
        return np.array(group)[text] if len(text) else text, *rest

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > PIECE:
            for at in range(0, len(t) - length + 1, PIECE):
                data = np.frombuffer(t[at:at + PIECE + length - 1], np.uint8)
                text, lo, *rest = runs(data, np.array([len(data)]), length, gram)
                yield text + i, lo + at, *rest
            continue
        if group and size + len(t) > PIECE:
            yield together()
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield together()


def resolve(pieces: list[bytes], windows: np.ndarray, length: int, budget: int = TUPLES) -> list[np.ndarray]:
    """For each piece the first and past-the-last window of every maximal
    range of windows that occur elsewhere among the pieces."""
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8) + np.uint8(2)  # separators 1, the end 0
    mark = np.zeros(len(data), bool)
    before = None
    for pos, prefix in suffixes(data, length, budget):
        hit = np.flatnonzero(prefix >= length)
        mark[pos[hit]] = True
        mark[pos[hit[hit > 0] - 1]] = True
        if before is not None and prefix[0] >= length:
            mark[before] = True
        before = int(pos[-1])
    at = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])))[:-1]
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, at, 1)
    np.add.at(valid, at + windows, -1)
    mark &= np.cumsum(valid[:-1], dtype=np.int8) > 0
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(at, start, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [np.stack((start[a:b] - at[i], end[a:b] - at[i]), 1) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2) with the 128-bit hash of the text."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), F.coalesce(ref(docs, text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))


def repeated_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, lo, n, anchor, run): runs whose anchor occurs again; those of
    equal texts come once for each copy."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, texts in batches_of(b.column(2)):
                for text, lo, windows, anchor, run in text_runs(texts, length, gram):
                    own = text + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[own]), pa.array(k2[own]), pa.array(lo, pa.int32()), pa.array(windows, pa.int32()),
                         pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64))], ["k1", "k2", "lo", "n", "anchor", "run"])

    found = rows.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, lo int, n int, anchor long, run long")
    # stated here, so that no reader of the runs adds it alone and the readers share one shuffle
    found = found.where(reduce(and_, [F.col(c).isNotNull() for c in ("k1", "k2", "lo", "n", "anchor", "run")]))
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("anchor")
    return split_join(found, again, ["anchor"], "left_semi").select("k1", "k2", "lo", "n", "anchor", "run")


def split_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keys``, a result grouped by ``on``.  A bit of the
    first key is named as a further key, which the grouping does not know:
    both sides are then plain shuffles, and the adaptive planner may split
    the partition of a hot key over many tasks."""
    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("odd", F.col(on[0]).bitwiseAND(F.lit(1)))

    return named(rows).join(named(keys), [*on, "odd"], how).drop("odd")


def sort_shards(pieces: DataFrame, length: int, sort_bytes: int, budget: int) -> DataFrame:
    """(k1, k2, a, b): repeated windows of single runs, from (anchor, k1, k2,
    lo, n, count, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def sort() -> pa.RecordBatch:
            ranges = resolve([h[5] for h in held], np.array([h[3] for h in held]), length, budget)
            out = [(h[0], h[1], h[2] + a, h[2] + b) for h, r in zip(held, ranges) if h[4] == 1 for a, b in r.tolist()]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k1", "k2", "a", "b"])

        for batch in batches:
            for anchor, *rest in zip(*(batch.column(c).to_pylist() for c in ("anchor", "k1", "k2", "lo", "n", "count", "piece"))):
                if size >= sort_bytes and anchor != last:
                    yield sort()
                    held, size = [], 0
                held.append(rest)
                size += len(rest[5]) + 1
                last = anchor
        if held:
            yield sort()

    return (pieces.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, "k1 long, k2 long, a int, b int"))


def cut_pieces(lists: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, k1, k2, lo, n, count, piece): the bytes of listed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, text, listed in zip(*(b.column(c) for c in ("k1", "k2", "text", "runs"))):
                data = text.as_py().encode()
                rows = [(r["anchor"], r["lo"], r["n"], r["count"]) for r in listed.as_py()]
                anchor, lo, n, count = zip(*rows)
                pieces = [data[x:x + k - 1 + length] for x, k in zip(lo, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array([k1.as_py()] * len(rows), pa.int64()), pa.array([k2.as_py()] * len(rows), pa.int64()),
                     pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(count, pa.int64()), pa.array(pieces, pa.binary())],
                    ["anchor", "k1", "k2", "lo", "n", "count", "piece"])

    return texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "copies", "runs").mapInArrow(
        run, "anchor long, k1 long, k2 long, lo int, n int, count long, piece binary")


def count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b): repeated windows of single runs, each window counted
    by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lo, n, count, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "n", "count", "piece"))):
                digests = [hashlib.blake2b(piece[i:i + length], digest_size=16).digest() for i in range(n)]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()),
                     pa.array(range(lo, lo + n), pa.int32()), pa.array([count] * n, pa.int64())], ["w1", "w2", "k1", "k2", "a", "count"])

    windows = pieces.mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, a int, count long")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("w1", "w2")
    return windows.where(F.col("count") == 1).join(again, ["w1", "w2"]).select("k1", "k2", "a", (F.col("a") + 1).alias("b"))


def kept(data: bytes, copies: int, ranges: list[tuple[int, int]], length: int) -> tuple[list[bytes], int, int]:
    """(remaining pieces, removed bytes, removed runs) from ranges of
    repeated windows."""
    if copies > 1 and len(data) >= length:
        return [], len(data), 1
    pieces, at, removed, spans = [], 0, 0, 0
    end = -1
    for a, b in sorted(ranges):
        b = b - 1 + length
        if a > end:
            pieces.append(data[at:a])
            spans += 1
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    return [*pieces, data[at:]], removed, spans


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                hot_runs: int = HOT_RUNS, sort_bytes: int = SORT_BYTES, budget: int = TUPLES) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (doc_id, k1, k2), and for every different text
    (k1, k2, n_bytes, n_removed, n_spans, remaining): the remaining bytes."""
    if not gram <= length <= 255:
        raise ValueError("length must be from the anchor's length to 255")
    rows = keyed(docs, id_col, text_col)
    found = repeated_runs(rows, length, gram)
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # Copies of a text count like other places: a text with copies goes
    # whole, so it is no matter that its runs count as repeated.  The filters
    # name "r" and "count" so that all readers of ``single`` share its shuffle.
    single = found.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("k1", "k2", "lo", "n")).alias("r"))
    several = single.groupBy("anchor").agg(F.count("r").alias("kinds"), F.sum("count").alias("rows")).where(
        (F.col("kinds") > 1) & (F.col("rows") > 1)).drop("rows")
    listed = split_join(single, several, ["anchor"]).select("anchor", "count", "kinds", "r.*")

    def lists(which) -> DataFrame:
        return listed.where(which).groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "lo", "n", "count")).alias("runs"))

    sorted_marks = sort_shards(cut_pieces(lists(F.col("kinds") <= hot_runs), texts, length), length, sort_bytes, budget)
    hot_marks = count_windows(cut_pieces(lists(F.col("kinds") > hot_runs), texts, length), length)
    equal = single.where((F.col("count") > 1) & F.col("r").isNotNull()).select("anchor", "run")
    equal_marks = split_join(found, equal, ["anchor", "run"], "left_semi").select("k1", "k2", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    marks = equal_marks.unionByName(sorted_marks).unionByName(hot_marks)
    # at most one range for each window of one text
    ranges = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    joined = texts.join(ranges, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copies, listed in zip(*(b.column(c) for c in ("text", "copies", "ranges"))):
                data = text.as_py().encode()
                pieces, removed, spans = kept(data, copies.as_py(), [(r["a"], r["b"]) for r in listed.as_py() or ()], length)
                out.append((len(data), removed, spans, b"".join(pieces)))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                                             ["k1", "k2", "n_bytes", "n_removed", "n_spans", "remaining"])

    result = joined.mapInArrow(remove, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, remaining binary")
    return rows.select("doc_id", "k1", "k2"), result


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, texts = dedup_texts(docs, **options)
    short = texts.select("k1", "k2", "n_bytes", "n_removed", "n_spans", F.sha2("remaining", 256).alias("kept_sha256"))
    return rows.join(short, ["k1", "k2"]).drop("k1", "k2")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the remaining text in place of the text, as bytes may
    be cut inside a character with the odd ones replaced; all columns kept."""
    _, texts = dedup_texts(docs, id_col=id_col, text_col=text_col, **options)
    whole = F.coalesce(ref(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("second"), whole).alias("k2"))
    joined = rows.join(texts.select("k1", "k2", "remaining"), ["k1", "k2"])
    new = F.when(F.col("doc").getField(text_col).isNotNull(), F.try_validate_utf8(F.make_valid_utf8(F.col("remaining").cast("string"))))
    return joined.select(F.col("doc").withField(f"`{text_col}`", new).alias("doc")).select("doc.*")
