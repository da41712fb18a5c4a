"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words.  Within a source each document
expects ``e = target / source size`` copies; the prefix sums of these
expectations plus one random offset per source run over the documents, and
a document is emitted once for every integer boundary that its interval
crosses.  DataFrame functions only.

The order within a source is (size class, hash of id and text): classes of
about 3 % width make neighbours alike in size, so the words taken stay
close to the target.  The prefix sum is never one window over a source:

1. equal documents of one scan partition collapse to a run with a count,
2. runs are numbered inside (source, size class, hash slice) cells,
3. cells get their offset from a window over the small table of cells.

Defined results: null or empty text has size 0, takes part in the order
and takes 0 words; a source without words has target 0 and no copies; a
null source is a source of its own, last in the order; repeated rows are
separate documents; an empty table gives an empty result.  Ids may be null
or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salarium.llm.common import HASH_BITS, WORD, md5_bits, ref, row_text
from salarium.session import materialize

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MAX_REPEAT = 3
#: Documents that one cell of the prefix sum should hold.
CELL_ROWS = 1 << 20


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of sources from (source, source_size).

    Targets share the total size by weight and stop at ``max_repeat`` times
    the source's size; the excess goes to the others by weight.  With the
    sources ordered by cap / weight, a source is capped exactly if its cap
    is below its share of what the sources before it have left.  The table
    has one row per source, so a window over it is small.
    """
    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(18,0)")

    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % n + 1).cast("int"))
    t = (sizes.withColumn("weight", weight)
         .withColumn("cap", F.col("source_size") * max_repeat)
         .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("onward", F.sum("weight").over(onward))
         .withColumn("capped", wide("cap") * wide("onward") <= wide("weight") * wide("left")))
    # the level of the first source that is not capped holds for all others
    level = F.max(F.when(~F.col("capped"), F.col("left") / F.col("onward"))).over(Window.partitionBy())
    return (t.withColumn("level", level)
            .select("source", "source_size",
                    F.when(F.col("capped"), F.col("cap").cast("double"))
                    .otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))).alias("target")))


def size_class(size: Column) -> Column:
    """Classes of equal width below 64 and of 1/32 octave above, growing
    with the size."""
    bits = F.length(F.bin(size)).cast("long")
    step = F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 6, F.lit(0))))
    return bits * 64 + step.cast("long")


def mixing_runs(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int,
                weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): one light row per document, and runs of equal documents
    of one scan partition with their first position in the source's order
    and the source's figures."""
    rows = docs.select(
        ref(docs, id_col).alias("doc_id"), ref(docs, source_col).alias("source"),
        word_count(ref(docs, text_col)).alias("size"),
        md5_bits(row_text(ref(docs, id_col), ref(docs, text_col))).alias("hash"),
        F.spark_partition_id().alias("part"))
    runs = materialize(rows.groupBy("source", "doc_id", "size", "hash", "part").agg(F.count(F.lit(1)).alias("n")))
    sizes = runs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    n_rows = runs.agg(F.sum("n")).first()[0] or 0
    slice_bits = max(4, (n_rows // CELL_ROWS).bit_length())
    cells = (runs.withColumn("class", size_class(F.col("size")))
             .withColumn("slice", F.shiftright("hash", HASH_BITS - slice_bits)))
    cell = ["source", "class", "slice"]
    in_cell = Window.partitionBy(*cell).orderBy("hash", F.col("doc_id").asc_nulls_first(), "size", "part")
    inner = F.coalesce(F.sum("n").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.groupBy(*cell).agg(F.sum("n").alias("cell_n"))
    ahead = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("class").alias("o_class"),
                             F.col("slice").alias("o_slice"),
                             F.coalesce(F.sum("cell_n").over(ahead), F.lit(0)).alias("ahead"))
    placed = cells.withColumn("inner", inner).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("class") == F.col("o_class"))
        & (F.col("slice") == F.col("o_slice")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))),
                                1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    placed = (placed.join(t, F.col("source").eqNullSafe(F.col("t_source")))
              .withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
              .withColumn("offset", offset)
              .select("doc_id", "source", "size", "hash", "part", "n", (F.col("ahead") + F.col("inner")).alias("start"),
                      "source_size", "target", "expected", "offset"))
    return rows, placed


def copies_at(position: Column, max_repeat: int) -> Column:
    """Integer boundaries that the interval of one document crosses; the
    upper limit only mends rounding, e is never above it."""
    lo = F.floor(F.col("offset") + F.col("expected") * position)
    hi = F.floor(F.col("offset") + F.col("expected") * (position + 1))
    return F.least(hi - lo, F.lit(max_repeat).cast("long"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One light row per document: doc_id, source, size, source_size,
    target and copies, without moving any text."""
    _, runs = mixing_runs(docs, id_col, text_col, source_col, seed, weights, max_repeat)
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target",
                       copies_at(F.col("start") + F.col("k"), max_repeat).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all columns kept, each as
    often as the sampling emits it.

    ``docs`` must be a table read (its scan partitions tell equal rows
    apart); a row that finds no run fails the job instead of vanishing.
    """
    _, runs = mixing_runs(docs, id_col, text_col, source_col, seed, weights, max_repeat)
    rows = docs.select(F.struct("*").alias("doc"), ref(docs, id_col).alias("id"), ref(docs, source_col).alias("src"),
                       word_count(ref(docs, text_col)).alias("words"),
                       md5_bits(row_text(ref(docs, id_col), ref(docs, text_col))).alias("key"),
                       F.spark_partition_id().alias("at"))
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source"))
                       & (F.col("words") == F.col("size")) & (F.col("key") == F.col("hash"))
                       & (F.col("at") == F.col("part")), "left")
    # at most the rows of one scan partition share a run
    same = Window.partitionBy("doc_id", "source", "size", "hash", "part").orderBy(F.lit(0))
    stray = F.raise_error(F.lit("docs must be a stable table read")).cast("long")
    place = F.when(F.col("start").isNull(), stray).otherwise(F.col("start") + F.row_number().over(same) - 1)
    return (joined.withColumn("position", place)
            .withColumn("copies", copies_at(F.col("position"), max_repeat)).where(F.col("copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc.*"))
