"""Persisted sketches of pay and headcount (approximate, opt-in).

One row a cell (by default city and activity) holds what any set of cells can
be merged from: exact counts, sums and extremes, a KLL sketch of the salaries
and HyperLogLog sketches of the employees and companies.  Cells are a few
kilobytes each whatever the number of records, a batch adds a run of cells,
and a question over any cells merges sketches instead of reading records.

KLL with k = 800 keeps ranks within about 0.5 % of all records
(``RANK_ERROR`` is a bound well above that), HyperLogLog with 2^14 registers
keeps counts within about 0.8 % (one standard error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.operators.joins import company_fact
from salarium.plans.report import NATIONAL_PERCENTILES
from salarium.sources.star import Star
from salarium.sources.versions import commit, read_table, stage

CELL = ("city", "activity_description")
KLL_K = 800
HLL_LG = 14
RANK_ERROR = 0.01
COUNT_ERROR = 0.04  # five standard errors
TABLE = "salary_sketches"


def sketch_cells(star: Star, keys=CELL, floor=1) -> DataFrame:
    """One row a cell: keys, records, total, least, most and the sketches.
    The sketches are aggregates with map-side partial state, so a hot cell is
    one row a task."""
    rows = company_fact(star).where(F.col("salary_amount") >= F.lit(floor))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.sum("salary_amount").alias("total"), F.min("salary_amount").alias("least"),
        F.max("salary_amount").alias("most"), F.expr(f"kll_sketch_agg_double(cast(salary_amount AS double), {KLL_K})").alias("pay"),
        F.expr(f"hll_sketch_agg(employee_id, {HLL_LG})").alias("people"), F.expr(f"hll_sketch_agg(company_id, {HLL_LG})").alias("companies"))


def merge_cells(cells: DataFrame, keys=()) -> DataFrame:
    """Cells (of several runs, or finer ones) merged by ``keys``."""
    return cells.groupBy(*keys).agg(
        F.sum("records").alias("records"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.expr("kll_merge_agg_double(pay)").alias("pay"), F.expr("hll_union_agg(people)").alias("people"),
        F.expr("hll_union_agg(companies)").alias("companies"))


def figures(cells: DataFrame, percentiles: dict[str, float] = NATIONAL_PERCENTILES) -> DataFrame:
    """What merged cells tell: counts (approximate for employees and
    companies), exact mean and extremes, approximate percentiles, which are
    salaries that occur."""
    held = [c for c in cells.columns if c not in ("records", "total", "least", "most", "pay", "people", "companies")]
    ranks = ", ".join(f"{p!r}D" for p in percentiles.values())
    quantiles = F.expr(f"kll_sketch_get_quantile_double(pay, array({ranks}))")
    return cells.withColumn("_q", quantiles).select(
        *held, F.col("records").alias("record_count"), F.expr("hll_sketch_estimate(people)").alias("employee_count"),
        F.expr("hll_sketch_estimate(companies)").alias("company_count"), F.try_divide(F.col("total").cast("double"), F.col("records")).alias("avg_salary"),
        F.col("least").cast("double").alias("min_salary"), F.col("most").cast("double").alias("max_salary"),
        *[F.col("_q")[i].alias(name) for i, name in enumerate(percentiles)])


def add_batch(spark: SparkSession, base: str, star: Star) -> int:
    """Sketch the records of a batch into one more run under ``base``."""
    return commit(spark, base, add={TABLE: stage(sketch_cells(star), base, TABLE)})


def sketched(spark: SparkSession, base: str, keys=(), where=None) -> DataFrame:
    """Figures by ``keys`` from the persisted cells that pass ``where``."""
    cells = read_table(spark, base, TABLE)
    return figures(merge_cells(cells if where is None else cells.where(where), keys))


def rank_errors(star: Star, found: DataFrame, key: str, percentiles: dict[str, float] = NATIONAL_PERCENTILES, floor=1) -> DataFrame:
    """(key, percentile_key, error): by how much of all records the exact
    rank of each approximate percentile misses its percentile (0 where equal
    salaries hold it)."""
    names = list(percentiles)
    fact = company_fact(star).where(F.col("salary_amount") >= F.lit(floor)).select(F.col(key).alias("_k"), F.col("salary_amount").cast("double").alias("v"))
    rows = fact.join(found.select(F.col(key), *names), F.col("_k").eqNullSafe(F.col(key)))
    sums = [F.sum(F.when(cond, 1).otherwise(0)).alias(f"{n}_{side}") for n in names for side, cond in (("below", F.col("v") < F.col(n)), ("upto", F.col("v") <= F.col(n)))]
    exact = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums)
    miss = [F.struct(F.lit(n).alias("percentile_key"), F.greatest(F.col(f"{n}_below") / F.col("n") - p, p - F.col(f"{n}_upto") / F.col("n"), F.lit(0.0)).alias("error"))
            for n, p in percentiles.items()]
    return exact.select(key, F.explode(F.array(*miss)).alias("e")).select(key, "e.percentile_key", "e.error")
