"""Importance resampling toward a target text collection.

Two passes over the texts hash every feature (a run of words) into one of
``BUCKETS`` counters: the first counts corpus and target, the second sums the
gains of each document from an array indexed by bucket.  A document's score
is its mean gain plus Gumbel noise from a hash of its id, so the highest
scores are a sample without replacement, likelier where the target is.

Ranks come from a least-significant-digit radix sort over distributed rows.
The composite key (score descending, id ascending) is cut into digits; a pass
counts the rows of each digit in each block of the current order, prefix sums
of those counts give every (block, digit) group its first destination, and
the row's place inside its group the rest.  A pass is stable, so after the
last digit the destination is the final rank.  Rows with equal key columns
travel as one row with a count, blocks hold a fixed share of the rows, and
nothing but ``BUCKETS`` counters and one row of key widths reaches the driver.

Defined results: null and empty texts have no features, weight 0 and no rank;
equal scores go to the smaller id, null ids last, then fewer features;
repeated rows each keep a row and a rank; without rows there is no result row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salarium.llm.common import batches_of, fresh, ref
from salarium.session import materialize

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
LEAST_WORDS = 20
SHARE_PERCENT = 10

#: Widest digit of the radix sort.
DIGIT_BITS = 16
#: Blocks of the current order for each shuffle partition.
BLOCKS_PER_PARTITION = 4

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CACHE_WORDS = 1 << 18


class Hashed(dict):
    """Buckets of features; emptied when it holds ``CACHE_WORDS``."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def feature_buckets(text: bytes, hashed: Hashed, ngram: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``ngram`` words;
    ``bytes.lower`` changes A-Z only."""
    words = WORD.findall(text.lower())
    runs = [words] if ngram == 1 else [[b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] for n in range(1, ngram + 1)]
    return len(words), np.fromiter((hashed[w] for run in runs for w in run), np.int64, sum(map(len, runs)))


def bucket_counts(docs: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: each task adds up its own rows, the
    driver receives one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in batches_of(batch.column(0)):
                for text in texts:
                    total += np.bincount(feature_buckets(text, hashed, ngram)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(ref(docs, text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that
    in the corpus."""
    add, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + add) / ((s + 1.0) * (t_all + add))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a standard Gumbel draw) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, ngram: int, seed: int, extra: list[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, and the
    columns of ``extra`` behind them."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        hashed = Hashed(len(gain))
        for batch in batches:
            for start, texts in batches_of(batch.column(0)):
                out = []
                for text in texts:
                    n, found = feature_buckets(text, hashed, ngram)
                    out.append((n, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
                part = batch.slice(start, len(texts))
                yield pa.record_batch([*part.columns[1:], *(pa.array(x, pa.int64()) for x in zip(*out))], schema=arrow_schema(part))

    def arrow_schema(part: pa.RecordBatch) -> pa.Schema:
        return pa.schema([*list(part.schema)[1:], *(pa.field(n, pa.int64()) for n in figures)])

    kept = [id_col, *extra]
    plain = [f"c{i}" for i in range(len(kept))]
    figures = ["n_words", "n_features", "weight"]
    rows = docs.select(ref(docs, text_col).cast("string").alias("text"), *(ref(docs, c).alias(p) for c, p in zip(kept, plain)))
    kinds = ", ".join([*(f"{p} {rows.schema[p].dataType.simpleString()}" for p in plain), *(f"{n} long" for n in figures)])
    rows = rows.mapInArrow(run, kinds)
    score = (F.col("weight") + noise(F.col("c0"), seed)).alias("score")
    return rows.select(F.col("c0").alias("doc_id"), *figures, score, *plain[1:])


def digits_of(keys: DataFrame) -> list[Column]:
    """The key's digits, least first.  Bits in which all rows agree sort
    nothing and are left out; one row tells which those are."""
    sign = F.lit(-(1 << 63))
    parts = {  # least significant first; unsigned order of each is the wanted one
        "id": F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(sign),
        "none": F.col("doc_id").isNull().cast("long"),
        "score": F.bitwise_not(F.col("score")).bitwiseXOR(sign),
    }
    spread = keys.agg(*[F.bit_or(c).bitwiseXOR(F.bit_and(c)).alias(n) for n, c in parts.items()]).first()
    digits = []
    for name, c in parts.items():
        width = ((spread[name] or 0) & ((1 << 64) - 1)).bit_length()
        if width:
            step = -(-width // -(-width // DIGIT_BITS))  # digits of about equal width
            digits += [F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << min(step, width - at)) - 1)) for at in range(0, width, step)]
    return digits or [F.lit(0).cast("long")]


def counting_pass(rows: DataFrame, digit: Column, block: Column, order: list) -> DataFrame:
    """One stable pass: ``pos`` becomes the destination of a row's first copy.

    ``block`` numbers the blocks of the current order, ``order`` sorts inside
    one.  All sums are over rows times their copies ``n``."""
    rows = rows.withColumns({"digit": digit, "block": block})
    groups = rows.groupBy("block", "digit").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2 ** DIGIT_BITS rows
    firsts = totals.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("first"))
    before = Window.partitionBy("digit").orderBy("block")
    starts = groups.select("block", "digit", (F.sum("n").over(before) - F.col("n")).alias("ahead")).join(firsts, "digit")
    inside = Window.partitionBy("block", "digit").orderBy(*order)
    place = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = rows.withColumn("place", place).join(starts, ["block", "digit"])
    return placed.withColumn("pos", F.col("first") + F.col("ahead") + F.col("place")).drop("digit", "block", "place", "first", "ahead")


def radix_ranks(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (doc_id, score and any more) with ``rank`` from 1,
    score descending, then doc_id ascending with nulls last, then by the
    other columns."""
    names = keys.columns
    rest = [c for c in names if c not in ("doc_id", "score")]
    rows = materialize(keys.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))  # equal rows travel as one
    total = rows.agg(F.sum("n")).first()[0] or 0
    digits = digits_of(rows)
    blocks = BLOCKS_PER_PARTITION * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-total // blocks))
    for i, digit in enumerate(digits):
        # any first order will do if equal keys stand together: rows of one
        # key in one block, by their other columns
        first = (F.pmod(F.xxhash64("doc_id", "score"), F.lit(blocks)), [*rest, "doc_id", "score"])
        block, order = first if i == 0 else (F.floor(F.col("pos") / size), ["pos"])
        rows = materialize(counting_pass(rows, digit, block, order))
    # copies expand in two steps, so a row with very many is spread over tasks
    step = 4096
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    hot = chunks.where(F.col("n") > step).repartition(*names, "chunk")
    many = chunks.where(F.col("n") <= step).unionByName(hot)
    copies = F.sequence(F.col("chunk") * step, F.least(F.col("n"), (F.col("chunk") + 1) * step) - 1)
    return many.withColumn("copy", F.explode(copies)).select(*names, (F.col("pos") + F.col("copy") + 1).alias("rank"))


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
                     share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS,
                     seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank null for
    rows that are not drawn."""
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    rows = materialize(weighted(docs, gain, id_col, text_col, ngram, seed))
    fit = rows.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = share_percent * fit.count() // 100
    ranked = radix_ranks(fit).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = rows.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    out = ranked.unionByName(short)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS,
             seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.  Only keys are
    sorted; the last drawn key then filters the texts (rows that share that
    key are drawn together)."""
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    names = docs.columns
    whole = weighted(docs, gain, id_col, text_col, ngram, seed, names)
    fit = whole.where(F.col("n_words") >= least_words)
    keys = materialize(fit.select("doc_id", "score"))
    drawn = share_percent * keys.count() // 100
    last = radix_ranks(keys).where(F.col("rank") == drawn).first()
    if last is None:
        return docs.limit(0)
    by_id = F.col("doc_id") <= F.lit(last["doc_id"]) if last["doc_id"] is not None else F.lit(True)
    kept = fit.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(by_id, F.lit(False))))
    return kept.select(*[f"c{i + 1}" for i in range(len(names))]).toDF(*names)
