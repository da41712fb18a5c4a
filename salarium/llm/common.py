"""Helpers shared by the operators: column hygiene, stable row identity,
portable hashes and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 60

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that clash with no column of ``df`` (Spark
    compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ref(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df[f"`{name}`"]


def md5_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of ``text`` as a non-negative long: a
    uniform hash that any SQL engine can reproduce."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_text(doc_id: Column, text: Column) -> Column:
    """One string that identifies a document's id and text; nulls differ
    from empty strings."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"),
                    F.coalesce(F.md5(text), F.lit("null")))


def batches_of(texts: pa.ChunkedArray | pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut one Arrow column of strings into (first row, UTF-8 byte strings)
    lists of about ``max_bytes``; null becomes empty.  A longer text comes
    alone, whole."""
    start, rows, size = 0, [], 0
    for i, value in enumerate(texts.cast(pa.large_binary())):
        b = value.as_py() or b""
        if rows and size + len(b) > max_bytes:
            yield start, rows
            start, rows, size = i, [], 0
        rows.append(b)
        size += len(b)
    if rows:
        yield start, rows


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, all columns as they
    are, whatever their names."""
    place = docs.columns.index(text_col)
    plain = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place).cast(pa.string())), pa.bool_()))

    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(plain, docs.schema.fields)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)
