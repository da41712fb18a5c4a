"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every unit vector by a fast pseudo-rotation (three rounds of
random signs and a Hadamard transform) and puts it into the bucket of the
nearest signed axis.  A query visits the buckets in the order of its own
coordinates: ``PROBES`` in each table, and on until they hold
``LEAST_CANDIDATES`` vectors, so a small table is searched whole.
Candidates are reranked exactly, in double precision, where they meet.

Equal vectors are one row of the index with their smallest ids (enough for
any answer), so a hot vector costs one row.  A bucket is cut into slices of
about ``SLICE`` vectors and its visitors into blocks of as many; each
(slice, block) is one group.  Only the bucket sizes reach the driver: two
numbers for each axis of each table.

Defined results: vectors that are null or zero, hold null or non-finite
components or are not of the most common length (the longer of equals), and
rows of null id take no part; repeated rows are separate candidates, and a
query leaves out one row of its own; ties go to the smaller id; with fewer
candidates than ``k`` all found are returned; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salarium.llm.common import ref
from salarium.session import materialize

TABLES = 5
PROBES = 24
LEAST_CANDIDATES = 1000
SLICE = 4096
SEED = 11
#: Error of a rough score for each component, at most, and pairs that are ranked at once.
ROUNDING = 1e-15
PAIRS = 1 << 16


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of rows, padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = x * rng.choice((-1.0, 1.0), n)
        h = 1
        while h < n:
            pair = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate((pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]), axis=2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def axes(x: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis: 2 i for +i, 2 i + 1 for -i."""
    top = np.abs(x).argmax(axis=1)
    return 2 * top + (x[np.arange(len(x)), top] < 0)


def vectors(packed) -> np.ndarray:
    rows = list(packed)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # the largest component first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): usable rows, the vector packed as doubles."""
    rows = table.select(ref(table, id_col).cast("long").alias("vec_id"), ref(table, vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + 0.0  # no negative zeros
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in flat[good]], pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(pack, "vec_id long, vec binary")


def index_rows(vecs: DataFrame, k: int) -> DataFrame:
    """(key, vec, ids): distinct vectors with their ``k + 1`` smallest ids.
    The ranks are cut before the shuffle, so a hot vector sends few rows."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = vecs.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.unhex(F.md5("vec")).alias("key"), "vec", "ids")


def slices(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    return {b: max(1, -(-n // SLICE)) for b, n in counts.items()}


def nearest(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for
    every row for which ``is_query(id)`` holds."""
    vecs = materialize(valid_vectors(table, id_col, vector_col))
    index = materialize(index_rows(vecs, k))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(vectors(b.column("vec").to_pylist()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)),
                                                      pa.array(axes(rotate(u, t)).astype(np.int32)), *b.columns],
                                                     ["tab", "bucket", "key", "vec", "ids"])

    members = index.select("key", "vec", "ids").mapInArrow(
        bucketed, "tab int, bucket int, key binary, vec binary, ids array<long>")
    held = {(r["tab"], r["bucket"]): r["count"] for r in members.groupBy("tab", "bucket").count().collect()}
    asked = vecs.where(is_query(F.col("vec_id"))).select(F.unhex(F.md5("vec")).alias("key"), "vec").groupBy("key").agg(F.first("vec").alias("vec"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                u = unit(vectors(part.column("vec").to_pylist()))
                for t in range(tables):
                    x = rotate(u, t)
                    size = np.array([held.get((t, i), 0) for i in range(2 * x.shape[1])])
                    order = np.argsort(-np.stack((x, -x), axis=2).reshape(len(x), -1), axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    go = ((np.arange(order.shape[1]) < probes) | (before < LEAST_CANDIDATES)) & (size[order] > 0)
                    row, col = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(order[row, col].astype(np.int32)),
                         part.column("key").take(pa.array(row)), part.column("vec").take(pa.array(row))], ["tab", "bucket", "key", "vec"])

    probed = asked.mapInArrow(visits, "tab int, bucket int, key binary, vec binary")
    met = {(r["tab"], r["bucket"]): r["count"] for r in probed.groupBy("tab", "bucket").count().collect()}
    member_slices, visit_slices = slices(held), slices(met)

    def cut(name: str, parts: dict, others: dict) -> list[Column]:
        """A row's own slice of its bucket, and a copy for each slice of the
        other side; one slice where the bucket is not cut."""

        def slices_of(counts: dict) -> Column:
            cells = [F.lit(x) for (t, i), n in sorted(counts.items()) if n > 1 for x in (t << 24 | i, n)]
            if not cells:
                return F.lit(1)
            return F.coalesce(F.create_map(*cells)[F.col("tab") * (1 << 24) + F.col("bucket")], F.lit(1))

        other = "query" if name == "member" else "member"
        return [F.pmod(F.hash("key"), slices_of(parts)).cast("int").alias(f"{name}_slice"),
                F.explode(F.sequence(F.lit(0), slices_of(others) - 1)).alias(f"{other}_slice")]

    members = members.select("*", *cut("member", member_slices, visit_slices))
    probed = probed.select("*", *cut("query", visit_slices, member_slices))
    group = ["tab", "bucket", "member_slice", "query_slice"]

    def rerank(mem: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(mem) or not len(ask):
            return pd.DataFrame({"q": [], "key": [], "score": [], "ids": []}, dtype=object)
        m, q = unit(vectors(mem["vec"])), unit(vectors(ask["vec"]))
        rough = q @ m.T
        n = min(len(m), k + 1)
        # all that rounding may put among the first, so that ties are told apart by exact cosine and id
        enough = np.partition(rough, len(m) - n, axis=1)[:, len(m) - n] - ROUNDING * (m.shape[1] + 8)
        x, y = vectors(ask["vec"]), vectors(mem["vec"])
        first = np.array([i[0] for i in mem["ids"]], np.int64)
        rows, cols, scores = [], [], []
        step = max(1, PAIRS // len(m))
        for at in range(0, len(q), step):
            row, col = np.nonzero(rough[at:at + step] >= enough[at:at + step, None])
            score = cosine(x[at + row], y[col])
            order = np.lexsort((first[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            rows.append(at + row[place < n])
            cols.append(col[place < n])
            scores.append(score[place < n])
        row, col = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({"q": ask["key"].to_numpy()[row], "key": mem["key"].to_numpy()[col],
                             "score": np.concatenate(scores), "ids": mem["ids"].to_numpy()[col]})

    found = members.groupBy(*group).cogroup(probed.groupBy(*group)).applyInPandas(
        rerank, "q binary, key binary, score double, ids array<long>")
    each = found.dropDuplicates(["q", "key"]).withColumn("vec_id", F.explode("ids"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    top = (each.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("q")
           .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", (F.col("q") == F.col("key")).alias("same")))).alias("top")))
    asks = vecs.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.unhex(F.md5("vec")).alias("own"))
    mine = F.expr("array_position(transform(top, x -> x.same AND x.vec_id = query_id), true)")
    others = F.slice(F.filter("top", lambda x, i: i + 1 != F.col("mine")), 1, k)
    return (asks.join(top, F.col("own") == F.col("q")).withColumn("mine", mine)
            .select("query_id", F.posexplode(others).alias("i", "x"))
            .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal pairs give equal values."""
    top_a, top_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    odd = (top_a > 1e150) | (top_a < 1e-150) | (top_b > 1e150) | (top_b < 1e-150)
    a, b = np.where(odd, a / top_a, a), np.where(odd, b / top_b, b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
