"""Inequality measures as distributed aggregates (global or per group).

The definitions are those of the reference's numpy functions, rewritten
over the rank frame (one row per distinct value with ``f`` copies and
``pre`` rows strictly below), so nothing is sorted in one place:

Empty input (global): record_count 0, Gini NULL (undefined -- the
reference raises), Hoover 0, Atkinson 0.

* Gini: shift by -min when min < 0, add 1e-7 to every value, then
  sum_i (2i - n - 1) x_i / (n sum x).  A tie group of value v at ranks
  pre+1 .. pre+f contributes v f (2 pre + f - n); the numerator does not
  change under a shift because sum_i (2i - n - 1) = 0.
* Hoover: 0 when empty or sum is 0, else sum |x - mean| / (2 sum x).
* Atkinson(eps): keep x > 0; 0 when empty; eps = 1: 1 - exp(mean ln x)/mean,
  else 1 - (mean x^(1-eps))^(1/(1-eps)) / mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.functions.numeric import INDEX_DIGITS, SPREAD_DIGITS, rnd
from salarium.operators.aggregates import sq_dev, stddev_samp_of
from salarium.operators.ranks import CUM, F_, PRE, V, RankFrame, rank_frame

# Fixed value (reference Gini): offset added to every value.
GINI_OFFSET = 1e-7
DEFAULT_EPSILON = 0.5


def gini_expr():
    n = F.col("n").cast("double")
    v = F.col(V).cast("double")
    term = v * F.col(F_).cast("double") * (2 * F.col(PRE) + F.col(F_) - F.col("n")).cast("double")
    return F.sum(F.when(F.col(V).isNotNull(), term)).alias("_gnum")


def atkinson_from(power_mean_sum: Column, rows: Column, pay: Column, epsilon: float) -> Column:
    """Atkinson index from the sum of v^(1 - epsilon) (of ln v for epsilon 1),
    the number and the sum of the positive values; 0 without any."""
    level = power_mean_sum / rows
    level = F.exp(level) if epsilon == 1 else F.pow(level, F.lit(1.0 / (1.0 - epsilon)))
    return F.when(F.coalesce(rows, F.lit(0)) == 0, F.lit(0.0)).otherwise(1 - level / (pay / rows))


def power_term(v: Column, epsilon: float) -> Column:
    return F.log(v) if epsilon == 1 else F.pow(v, F.lit(1.0 - epsilon))


def inequality_aggs(epsilon: float = DEFAULT_EPSILON) -> list[Column]:
    """Aggregates over a rank frame from which ``inequality_cols`` makes the
    indexes."""
    v = F.col(V).cast("double")
    f = F.col(F_).cast("double")
    mean = F.col("total").cast("double") / F.col("n").cast("double")
    pos = F.col(V) > 0
    return [
        gini_expr(),
        F.first("n", True).alias("n"),
        F.first("total", True).cast("double").alias("_sum"),
        F.first("vmin", True).cast("double").alias("_min"),
        F.sum(f * F.abs(v - mean)).alias("_absdev"),
        F.sum(F.when(pos, f)).alias("_pn"),
        F.sum(F.when(pos, f * v)).alias("_ps"),
        F.sum(F.when(pos, f * power_term(v, epsilon))).alias("_pa"),
        sq_dev(v, f).alias("_d2"),
    ]


def inequality_cols(epsilon: float = DEFAULT_EPSILON, digits: int | None = INDEX_DIGITS) -> dict[str, Column]:
    """record_count, gini, hoover, atkinson and stddev_salary by name."""
    n = F.col("n").cast("double")
    shift = F.when(F.col("_min") < 0, n * F.col("_min")).otherwise(F.lit(0.0))
    gini = F.col("_gnum") / (n * (F.col("_sum") + n * F.lit(GINI_OFFSET) - shift))
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    hoover = F.when(empty | (F.coalesce(F.col("_sum"), F.lit(0.0)) == 0), F.lit(0.0))\
              .otherwise(F.col("_absdev") / (2 * F.col("_sum")))
    atk = atkinson_from(F.col("_pa"), F.col("_pn"), F.col("_ps"), epsilon)

    def r(c):
        return F.round(c, digits) if digits is not None else c
    cols = {"record_count": F.coalesce(F.col("n"), F.lit(0)), "gini": r(gini), "hoover": r(hoover), "atkinson": r(atk),
            "stddev_salary": rnd(stddev_samp_of(F.col("n"), F.col("_d2")), SPREAD_DIGITS)}
    return {name: c.alias(name) for name, c in cols.items()}


def inequality(rf: RankFrame, epsilon: float = DEFAULT_EPSILON,
               digits: int | None = INDEX_DIGITS, with_stddev: bool = False) -> DataFrame:
    """Gini, Hoover and Atkinson per group in one aggregate over the frame
    (optionally the sample stddev too)."""
    g = rf.df.where(F.col(V).isNotNull()).groupBy(*rf.groups).agg(*inequality_aggs(epsilon))
    cols = inequality_cols(epsilon, digits)
    if not with_stddev:
        cols.pop("stddev_salary")
    return g.select(*rf.groups, *cols.values())


def atkinson_index(df: DataFrame, value: str = "salary_amount", epsilon: float = DEFAULT_EPSILON,
                   digits: int = INDEX_DIGITS) -> DataFrame:
    """I3 alone: one aggregate over the positive values."""
    v = F.col(value).cast("double")
    one = df.where(F.col(value) > 0).agg(F.sum(power_term(v, epsilon)).alias("_pa"), F.count(value).alias("_pn"),
                                         F.sum(value).cast("double").alias("_ps"))
    return one.select(F.round(atkinson_from(F.col("_pa"), F.col("_pn"), F.col("_ps"), epsilon), digits).alias("atkinson"))


def inequality_of(df: DataFrame, value: str = "salary_amount", groups=(),
                  epsilon: float = DEFAULT_EPSILON, digits: int | None = INDEX_DIGITS) -> DataFrame:
    rf = rank_frame(df.select(*groups, value), value, groups)
    return inequality(rf, epsilon, digits)


def running_share(rf: RankFrame, chunk: int = 100_000) -> DataFrame:
    """Every row's cumulative income share in ascending order:
    ``*groups, position (1-based), x = (pos)/(n-1), cumulative_share``."""
    from salarium.operators.ranks import expand_rows
    rows = expand_rows(rf, chunk).where(F.col(V).isNotNull())
    cum = F.col(CUM) + F.col(V) * (F.col("pos") - F.col(PRE) + 1)
    return rows.select(*rf.groups, (F.col("pos") + 1).alias("position"),
                       F.when(F.col("n") > 1, F.col("pos").cast("double") / (F.col("n") - 1).cast("double"))
                        .otherwise(F.lit(0.0)).alias("x"),
                       F.try_divide(cum.cast("double"), F.col("total").cast("double"))
                        .alias("cumulative_share"))
