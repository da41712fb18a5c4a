"""Distributed rank core: exact order statistics without a global window.

``Window.orderBy(v)`` with no partition moves every row into one task.
Instead (per optional group key ``g``):

1. ``hist``: ``groupBy(g, v).count()`` -- partial aggregation; ties collapse,
   so a value held by a third of all rows is a single row here.
2. Range buckets.  The bucket is a pure function of the value (binary
   search in a fixed boundary array), so a recomputed partition lands in
   the same bucket and a tie group never straddles two buckets.
   * exact-resolution values (DECIMAL, integers -- salaries): fixed
     log-spaced buckets, 32 per doubling on both signs, computed with
     integer arithmetic (``log_bucket``).  No data pass is needed, the
     bucket count has a hard bound (so the offsets table below may be
     broadcast), and because values have a fixed resolution a bucket
     [t, t*(1+1/32)) holds at most t/32/ulp + 1 distinct values, whatever
     the data size.
   * DOUBLE values and decimals wider than 18 digits: the same steps of the
     double's base-2 logarithm (``double_bucket``), a hard bound as well.
   * uniform hashes: their leading bits (``hash_bucket``).
3. Per (g, bucket) totals -> exclusive prefix offsets per group.
4. ``Window.partitionBy(g, bucket).orderBy(v)`` running sums of ``f`` and
   ``v*f`` (rows strictly below) plus the offsets give, for every distinct
   value, ``pre`` (rows strictly below), ``cum`` (sum strictly below), and
   the group's ``n``, ``total``.

Everything else -- percent rank, exact PERCENTILE_CONT, NTILE, Lorenz points,
Gini -- is a plain aggregate or bounded explode over that frame.  A hot
group spans many buckets, so no task ever holds a whole large group.

NULL values sort last (the reference's ``ORDER BY x`` in PostgreSQL), count
in ``n_rows`` and in rank positions, and are ignored by sums and
percentiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

V, F_, PRE, CUM, B = "v", "f", "pre", "cum", "_bucket"


LOG_STEPS_BITS = 5      # 2^5 = 32 buckets per doubling of |value|
NULL_BUCKET = 1 << 30   # NULL / NaN values: one bucket after all others


def log_bucket(unscaled: Column) -> Column:
    """Exact, monotone bucket of an integer (a DECIMAL's unscaled value):
    octave e = floor(log2 |u|) from the length of its binary string, then
    32 equal steps inside the octave: floor((|u| / 2^e - 1) * 32).  Division
    by a power of two is exact in binary floating point, so the bucket is
    exact for |u| < 2^53 and deterministic on every executor beyond it.
    Buckets are mirrored for negative values and 0 has its own; at most
    2 * 64 * 32 + 2 distinct buckets."""
    steps = 1 << LOG_STEPS_BITS
    a = F.abs(unscaled)
    e = (F.length(F.bin(a)) - 1).cast("int")
    sub = F.floor((a.cast("double") / F.pow(F.lit(2.0), e) - 1.0) * steps)
    mag = e.cast("long") * steps + sub.cast("long")
    b = (F.when(unscaled > 0, mag)
          .when(unscaled < 0, -mag - 2)
          .when(unscaled == 0, F.lit(-1))).cast("int")
    # Non-nullable on purpose: a nullable join key makes the optimizer push
    # an inferred IS NOT NULL below the histogram aggregate on one branch
    # only, and the two uses of the histogram would then shuffle twice.
    return F.coalesce(b, F.lit(NULL_BUCKET))


def double_bucket(v: Column) -> Column:
    """Monotone bucket of a double: 32 steps of log2 |v| per octave, mirrored
    for negative values, 0 between; NULL and NaN last.  The logarithm is
    monotone, so a tie group never straddles two buckets; at most about
    134,000 distinct buckets over the whole range of doubles."""
    a = F.abs(v)
    mag = (F.floor(F.log2(a) * (1 << LOG_STEPS_BITS)) + (1100 << LOG_STEPS_BITS)).cast("int")
    b = (F.when(F.isnan(v), F.lit(NULL_BUCKET)).when(a == float("inf"), F.signum(v).cast("int") * (1 << 20))
          .when(v > 0, mag).when(v < 0, -mag).when(v == 0, F.lit(0)))
    return F.coalesce(b, F.lit(NULL_BUCKET))   # non-nullable, see log_bucket


HASH_BITS = 60   # width of the hashes that ``hash_bucket`` takes


def hash_bucket(df: DataFrame, h: Column) -> Column:
    """Bucket of a uniform ``HASH_BITS``-bit hash: its leading bits, about
    four buckets per shuffle partition and at most 2^14, so the largest
    bucket shrinks as partitions are added."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(14, max(8, (4 * parts).bit_length()))
    return F.coalesce(F.shiftright(h, HASH_BITS - bits).cast("int"), F.lit(NULL_BUCKET))


def value_bucket(hist: DataFrame) -> Column:
    """Bucket of the value column by its type."""
    dt = hist.schema[V].dataType
    if isinstance(dt, T.DecimalType) and dt.precision <= 18:
        return log_bucket((F.col(V) * F.lit(10 ** dt.scale)).cast("long"))
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        # |Long.MIN| has no long: it shares the bucket of its neighbour
        return log_bucket(F.greatest(F.col(V).cast("long"), F.lit(-(2 ** 63 - 1))))
    return double_bucket(F.col(V).cast("double"))


def from_edge(hist: DataFrame) -> tuple[str, str, float | None]:
    """SQL for the distance of ``v`` from the edge of its bucket ``_bucket``
    and for the edge, and the steps per unit.  The edge is a function of the
    bucket alone.  Values of a fixed resolution count in whole steps, longs;
    others as doubles."""
    dt, steps = hist.schema[V].dataType, 1 << LOG_STEPS_BITS
    if isinstance(dt, T.DecimalType) and dt.precision > 18 or isinstance(dt, (T.DoubleType, T.FloatType)):
        edge = f"(signum(_bucket) * pow(2D, least(abs(_bucket), {2123 << LOG_STEPS_BITS}) / {steps}D - 1100))"
        return f"(cast(v AS double) - {edge})", edge, None
    scale = 10 ** (dt.scale if isinstance(dt, T.DecimalType) else 0)
    mag = "if(_bucket >= 0, _bucket, -_bucket - 2)"
    size = f"cast(floor(pow(2D, {mag} div {steps}) * (1 + ({mag} % {steps}) / {steps}D)) AS bigint)"
    edge = f"(CASE WHEN _bucket = -1 THEN 0L WHEN _bucket >= 0 THEN {size} ELSE -{size} END)"
    return f"(cast(v * {scale} AS bigint) - {edge})", edge, float(scale)


@dataclass
class RankFrame:
    """One row per (group, distinct value) with rank prefix columns.

    Columns: ``*groups, v, f, pre, cum, n_rows, n, total, vmin, vmax``.
    ``n_rows`` counts NULL values, ``n`` does not.
    """
    df: DataFrame
    groups: tuple[str, ...]

    # -- expressions ----------------------------------------------------
    @staticmethod
    def percent_rank() -> Column:
        """(rank - 1) / (rows - 1); 0 for a single row."""
        return F.when(F.col("n_rows") > 1,
                      F.col(PRE).cast("double") / (F.col("n_rows") - 1).cast("double"))\
                .otherwise(F.lit(0.0))


def rank_frame(df: DataFrame, value: str | Column, groups=(), *, bucket: Column | None = None) -> RankFrame:
    """Build the rank frame of ``value`` (optionally per ``groups``).
    ``bucket``: a monotone bucket of the value column ``v`` in place of the
    one chosen by its type."""
    groups = tuple(groups)
    vcol = F.col(value) if isinstance(value, str) else value
    hist = (df.groupBy(*groups, vcol.alias(V))
              .agg(F.count(F.lit(1)).alias(F_)))
    return frame_from_hist(hist, groups, bucket=bucket)


SIDE_BUCKETS = 1024
SIDE_BASE = -(1 << 20)   # below every value bucket


def side_bucket(*ids: Column) -> Column:
    """Bucket for weight-0 side rows (see ``frame_from_hist``): a hash of
    the row's id spread over ``SIDE_BUCKETS`` buckets below all values."""
    return (F.lit(SIDE_BASE) - F.pmod(F.xxhash64(*ids), F.lit(SIDE_BUCKETS))).cast("int")


def frame_from_hist(hist: DataFrame, groups=(), *, bucket: Column | None = None,
                    carry=(), side: str | None = None) -> RankFrame:
    """Rank frame from an already aggregated histogram ``(*groups, v, f)``
    (one row per group and distinct value).

    ``carry``: extra columns passed through to the frame.  ``side``: a
    column holding a bucket for *side rows* -- rows with ``f = 0`` and
    ``v`` NULL that ride along (e.g. distinct ids to count per group in the
    same final aggregate).  They stay out of the bucket totals and get NULL
    rank columns; the side bucket spreads them over many tasks.  Consumers
    read group constants with ``max`` (NULL on side rows)."""
    groups = tuple(groups)
    lb = value_bucket(hist) if bucket is None else bucket
    hb = hist.withColumn(B, F.coalesce(F.col(side), lb) if side else lb)
    vf = F.col(V) * F.col(F_)

    # Per (group, bucket) totals and exclusive prefix offsets: bounded per
    # group by the number of buckets.
    # side rows (weight 0) need no offsets: keep them out of the totals.
    # Filter on the weight, not on the side column: a predicate on grouping
    # columns would be pushed below the shared histogram aggregate and make
    # this branch stop reusing its shuffle.
    tot = (hb.where(F.col(F_) > 0) if side else hb).groupBy(*groups, B).agg(
        F.sum(F_).alias("_bf"),
        F.sum(F.when(F.col(V).isNotNull(), F.col(F_)).otherwise(0)).alias("_bn"),
        F.sum(vf).alias("_bs"),
        F.min(V).alias("_bmin"),
        F.max(V).alias("_bmax"))
    wprev = Window.partitionBy(*groups).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*groups)
    offsets = tot.select(
        *groups, B,
        F.coalesce(F.sum("_bf").over(wprev), F.lit(0)).alias("_off_f"),
        F.coalesce(F.sum("_bs").over(wprev), F.lit(0)).alias("_off_s"),
        F.sum("_bf").over(wall).alias("n_rows"),
        F.sum("_bn").over(wall).alias("n"),
        F.sum("_bs").over(wall).alias("total"),
        F.min("_bmin").over(wall).alias("vmin"),
        F.max("_bmax").over(wall).alias("vmax"))
    if groups:
        # Group keys may be NULL (a view keeps the NULL city): join on one
        # struct key, which matches NULL to NULL and still hash-partitions,
        # so the window below reuses the join's partitioning.
        # A 64-bit hash leads the key so sorts and joins compare longs; the
        # struct follows for exactness (equal hashes of different groups
        # stay apart).
        gh = F.xxhash64(*[F.col(c) for c in groups])
        hb = hb.withColumn("_gh", gh).withColumn("_g", F.struct(*groups))
        offsets = offsets.withColumn("_gh", gh).withColumn("_g", F.struct(*groups)).drop(*groups)
        keys = ["_gh", "_g", B]
    else:
        # One row per non-empty bucket: at most ~4100 rows (log buckets), 2^14
        # (hash buckets) or ~134,000 (doubles, about 10 MB) -- a proven bound,
        # so it is broadcast.
        offsets = F.broadcast(offsets)
        keys = [B]

    win = (Window.partitionBy(*keys).orderBy(F.col(V).asc_nulls_last())
           .rowsBetween(Window.unboundedPreceding, -1))
    # side rows find no offsets row (LEFT join) and keep NULL rank columns
    frame = (hb.join(offsets, keys, "left" if side else "inner")
             .select(*groups, V, F_,
                     (F.col("_off_f") + F.coalesce(F.sum(F_).over(win), F.lit(0))).alias(PRE),
                     (F.col("_off_s") + F.coalesce(F.sum(vf).over(win), F.lit(0))).alias(CUM),
                     "n_rows", "n", "total", "vmin", "vmax", *carry))
    return RankFrame(frame, groups)


# ---------------------------------------------------------------------------
# Consumers
# ---------------------------------------------------------------------------

def quantile_exprs(probs: dict[str, float]) -> list[Column]:
    """Aggregate expressions for exact PERCENTILE_CONT over a rank frame:
    k = (n-1)p, linear interpolation between positions floor(k), ceil(k).
    Each is one SQL expression string: one round trip to the JVM instead of
    one per sub-expression when the plan is built."""
    out = []
    for name, p in probs.items():
        k = f"(CAST(n - 1 AS DOUBLE) * CAST({float(p)!r} AS DOUBLE))"
        at = ("MAX(CASE WHEN {pre} <= {pos} AND {pos} < {pre} + {f} THEN CAST({v} AS DOUBLE) END)")
        out += [F.expr(at.format(pre=PRE, f=F_, v=V, pos=f"FLOOR({k})") + f" AS `_lo_{name}`"),
                F.expr(at.format(pre=PRE, f=F_, v=V, pos=f"CEIL({k})") + f" AS `_hi_{name}`"),
                F.expr(f"FIRST({k} - FLOOR({k}), true) AS `_fr_{name}`")]
    return out


def quantile_value(name: str) -> Column:
    """Interpolated value from the columns made by ``quantile_exprs``."""
    lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
    return lo + (hi - lo) * fr


def quantile_finish(probs: dict[str, float]) -> list[Column]:
    return [quantile_value(n).alias(n) for n in probs]


def quantiles(rf: RankFrame, probs: dict[str, float]) -> DataFrame:
    """Exact PERCENTILE_CONT per group: columns ``*groups, <name>...``."""
    agg = rf.df.where(F.col("n") > 0).groupBy(*rf.groups).agg(*quantile_exprs(probs))
    return agg.select(*rf.groups, *quantile_finish(probs))


def ntile_pieces(rf: RankFrame, tiles: int = 10, carry=()) -> DataFrame:
    """NTILE(tiles) over the value order as (``*groups, v, tile, rows``):
    how many rows of each distinct value fall in each tile.  With
    n = tiles*q + r the first r tiles hold q+1 rows; a tie group straddling
    a tile edge is split by count (which tied row goes where is arbitrary
    in SQL; the counts are not).  A hist row spans at most ``tiles`` tiles."""
    n = F.col("n_rows")
    q = F.floor(n / F.lit(tiles)).cast("long")
    r = (n - q * F.lit(tiles)).cast("long")
    big = r * (q + 1)

    def tile_of(pos: Column) -> Column:   # 0-based tile of 0-based position
        return F.when(pos < big, F.floor(pos / (q + 1)))\
                .otherwise(r + F.floor(F.try_divide(pos - big, q))).cast("long")

    def start(t: Column) -> Column:
        return t * q + F.least(t, r)

    pre, f = F.col(PRE), F.col(F_)
    ex = rf.df.withColumn("_t", F.explode(F.sequence(tile_of(pre), tile_of(pre + f - 1))))
    t = F.col("_t")
    overlap = F.least(pre + f, start(t + 1)) - F.greatest(pre, start(t))
    return ex.select(*rf.groups, V, (t + 1).alias("tile"), overlap.cast("long").alias("rows"),
                     *[F.col(c).alias(f"_carry_{c}") for c in carry])


def ntile(rf: RankFrame, tiles: int = 10) -> DataFrame:
    """NTILE(tiles) aggregated per tile: ``*groups, tile, rows, total,
    group_total`` (the group's whole sum rides along, so shares need no
    second pass)."""
    return (ntile_pieces(rf, tiles, carry=("total",)).groupBy(*rf.groups, "tile")
            .agg(F.sum("rows").alias("rows"), F.sum(F.col(V) * F.col("rows")).alias("total"),
                 F.max("_carry_total").alias("group_total")))


def lorenz_curve(rf: RankFrame) -> DataFrame:
    """The exact Lorenz curve as its corner points: the first row, and the
    last row of every group of equal values (between them the curve is a
    straight line).  ``*groups, i, x = i / (n - 1), y = cumulative share``."""
    df = rf.df.where(F.col(V).isNotNull() & (F.col("n") > 0))
    last = F.col(PRE) + F.col(F_) - 1
    rows = F.when(F.col(PRE) == 0, F.array_distinct(F.array(F.lit(0).cast("long"), last))).otherwise(F.array(last))
    return _curve_points(df.withColumn("i", F.explode(rows)), rf.groups)


def _curve_points(df: DataFrame, groups) -> DataFrame:
    return df.select(*groups, "i",
                     F.when(F.col("n") > 1, F.col("i").cast("double") / (F.col("n") - 1).cast("double"))
                      .otherwise(F.lit(0.0)).alias("x"),
                     F.try_divide((F.col(CUM) + F.col(V) * (F.col("i") - F.col(PRE) + 1)).cast("double"),
                                  F.col("total").cast("double")).alias("y"))


def lorenz_points(rf: RankFrame, points: int = 100) -> DataFrame:
    """Exact Lorenz-curve points at row indices floor(j*(n-1)/points),
    j = 0..points: x = i/(n-1), y = cumulative sum through row i / total.
    Bounded output (<= points+1 rows per group); ties are split by count."""
    K = F.lit(points).cast("long")
    n1 = F.greatest(F.col("n") - 1, F.lit(1)).cast("long")
    pre, f = F.col(PRE), F.col(F_)

    def ceil_div(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b).cast("long")

    df = rf.df.where(F.col(V).isNotNull() & (F.col("n") > 0))
    j_lo = ceil_div(pre * K, n1)
    j_hi = F.least(ceil_div((pre + f) * K, n1) - 1, K)
    ex = (df.where(j_lo <= j_hi)
            .withColumn("_j", F.explode(F.sequence(j_lo, j_hi)))
            .withColumn("i", F.floor(F.col("_j") * F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0) / K).cast("long")))
    return _curve_points(ex, rf.groups).dropDuplicates([*rf.groups, "i"])


def expand_rows(rf: RankFrame, chunk: int = 100_000) -> DataFrame:
    """One output row per input row: ``*groups, v, pos`` (0-based position in
    value order).  A hot tie group is first cut into chunks that a shuffle
    spreads over tasks, and only then expanded, so no task emits the whole
    group."""
    C = F.lit(chunk).cast("long")
    f = F.col(F_)
    chunks = (rf.df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"),
                                                          F.floor((f - 1) / C).cast("long"))))
                 .repartition("_c", *rf.groups, V))
    start = F.col(PRE) + F.col("_c") * C
    stop = F.least(F.col(PRE) + f, start + C) - 1
    return chunks.select(*rf.groups, V, F_, PRE, CUM, "n_rows", "n", "total",
                         F.explode(F.sequence(start, stop)).alias("pos"))
