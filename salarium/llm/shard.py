"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  It starts
as one bucket; only a bucket above the byte limit splits on one more bit,
until every bucket fits.  DataFrame functions only.

The directory grows in rounds of ``STEP_BITS`` bits: a round sums the bytes
of the cells (all bits of the round) of the buckets still open, and every
cell takes the shallowest depth at which its bucket fits.  A round reads
only the rows of open buckets, and only cells meet in a window.

Defined results: null or empty text has 0 bytes; equal documents get a copy
number that enters their hash, so a hot document spreads like any other; a
document larger than the limit ends alone in its shard, which is the only
shard above the limit; the shard of a corpus below the limit is the root,
named by the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salarium.llm.common import HASH_BITS, fresh, md5_bits, ref, row_text
from salarium.session import materialize

#: Bytes of text in a shard, at most.
LIMIT_BYTES = 32 << 20
#: Bits added to the directory by one round.
STEP_BITS = 8


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def copy_hash(text: Column, copy: Column) -> Column:
    """Hash of one of several equal documents."""
    return md5_bits(F.concat(text, F.lit("#"), copy.cast("string")))


def prefix(value: Column, bits: int, of: int = HASH_BITS) -> Column:
    return F.shiftright(value, of - bits)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The directory of (hash, n_bytes) rows as cells: (cell_bits, cell,
    depth, shard_bytes, shard_docs)."""
    decided, open_rows, done = [], rows, 0
    while done < HASH_BITS:
        bits = min(done + STEP_BITS, HASH_BITS)
        cells = (open_rows.groupBy(prefix(F.col("hash"), bits).alias("cell"))
                 .agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")))
        bucket = Window.partitionBy("depth", "bucket")
        levels = (cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(bits))))
                  .withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
                  .withColumn("shard_bytes", F.sum("bytes").over(bucket))
                  .withColumn("shard_docs", F.sum("docs").over(bucket)))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == HASH_BITS)
        best = F.min(F.when(fits, F.struct("depth", "shard_bytes", "shard_docs")))
        cells = materialize(levels.groupBy("cell").agg(best.alias("best"))
                            .select(F.lit(bits).alias("cell_bits"), "cell", "best.*"))
        decided.append(cells.where(F.col("depth").isNotNull()))
        still = cells.where(F.col("depth").isNull()).select(F.col("cell").alias("open_cell"))
        if still.isEmpty():
            break
        open_rows = open_rows.join(still, prefix(F.col("hash"), bits) == F.col("open_cell"), "left_semi")
        done = bits
    return reduce(DataFrame.unionByName, decided)


def document_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal documents of one scan partition as runs, with the number of
    copies in the scan partitions before."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), text_bytes(ref(docs, text_col)).alias("n_bytes"),
                       row_text(ref(docs, id_col), ref(docs, text_col)).alias("row"), F.spark_partition_id().alias("part"))
    runs = rows.groupBy("row", "doc_id", "n_bytes", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def located(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(hash, …) rows with their shard."""
    levels = [r[0] for r in cells.select("cell_bits").distinct().collect()]
    parts = []
    for bits in sorted(levels):
        here = cells.where(F.col("cell_bits") == bits).drop("cell_bits")
        parts.append(rows.join(here, prefix(F.col("hash"), bits) == F.col("cell"))
                     .withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(
                         F.expr(f"lpad(bin(shiftright(cell, {bits} - depth)), depth, '0')")))
                     .drop("cell"))
    if not parts:
        return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                                  (("depth", "int"), ("shard_bytes", "long"), ("shard_docs", "long"), ("shard", "string"))])
    return reduce(DataFrame.unionByName, parts)


def hashed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One light row per document with the hash that places it."""
    each = (document_runs(docs, id_col, text_col)
            .withColumn("copy", F.explode(F.expr("sequence(first, first + n - 1)"))))
    return materialize(each.select("doc_id", "n_bytes", copy_hash(F.col("row"), F.col("copy")).alias("hash")))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  limit: int = LIMIT_BYTES) -> DataFrame:
    """One light row per document: doc_id, n_bytes, shard (the bits of its
    bucket), depth, shard_bytes, shard_docs.  No text moves."""
    rows = hashed_rows(docs, id_col, text_col)
    out = located(rows, directory(rows.select("hash", "n_bytes"), limit))
    return out.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES,
                    out_col: str = "shard") -> DataFrame:
    """``docs``, all columns kept, with the shard in ``out_col`` (renamed if
    taken): what a writer partitions by.  ``docs`` must be a table read (its
    scan partitions tell equal rows apart); a row that finds no run fails
    the job instead of vanishing."""
    cells = directory(hashed_rows(docs, id_col, text_col).select("hash", "n_bytes"), limit)
    runs = document_runs(docs, id_col, text_col).select(
        F.col("row").alias("r_row"), F.col("part").alias("r_part"), F.col("first"))
    rows = docs.select(F.struct("*").alias("doc"), row_text(ref(docs, id_col), ref(docs, text_col)).alias("row"),
                       F.spark_partition_id().alias("part"))
    # at most the rows of one scan partition share a run
    place = F.row_number().over(Window.partitionBy("r_row", "r_part").orderBy(F.lit(0))) - 1
    stray = F.raise_error(F.lit("docs must be a stable table read")).cast("long")
    rows = (rows.join(runs, (F.col("row") == F.col("r_row")) & (F.col("part") == F.col("r_part")), "left")
            .withColumn("copy", F.when(F.col("first").isNull(), stray).otherwise(F.col("first") + place))
            .select("doc", copy_hash(F.col("row"), F.col("copy")).alias("hash")))
    name, = fresh(docs, out_col)
    return located(rows, cells).select("doc.*", F.col("shard").alias(name))
