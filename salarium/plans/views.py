"""The reference's SQL views and ad-hoc analysis queries as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salarium.functions.criteria import contains_ci, name_or_activity_ilike, salary_between
from salarium.functions.numeric import (INDEX_DIGITS, PERCENTILE_DIGITS, mean_round2,
                                        ratio, rnd)
from salarium.operators.aggregates import MEDIAN, reduced, reduced_by_company, salary_stats
from salarium.operators.joins import (DETAIL_COLUMNS, company_fact, company_sizes,
                                      employee_fact, sizes_of_lots, star_detail)
from salarium.operators.ranks import F_, V, quantile_exprs, quantile_value, rank_frame
from salarium.sources.star import Star

# Fixed values (reference query parameters).
TOP_SHARE_GROUPS = [("Top 0.1%", 0.999), ("Top 1%", 0.99), ("Top 10%", 0.9)]
NAME_TOKEN_MIN_COUNT = 20
NAME_TOKEN_LIMIT = 100
SALARY_BAND = (50000, 100000)


def company_summary(star: Star, people: DataFrame | None = None) -> DataFrame:
    """A1 / V1: every company (LEFT JOIN) with distinct employees, rounded
    mean, max and min; companies without records get 0.  ``people``: the
    records as ``all_people``, if they are at hand."""
    if people is None:
        return summary_rows(star.companies, company_sizes(star))
    return summary_rows(star.companies, sizes_of_lots(people))


def summary_rows(companies: DataFrame, sizes: DataFrame) -> DataFrame:
    """A1 from figures by company: size, paid, pay, lowest, highest."""
    mean = F.round(F.try_divide(F.col("pay"), F.col("paid")), 2).cast("double")
    zero = F.lit(0.0)
    return companies.join(sizes, "company_id", "left").select(
        "company_id", "company_name", "activity_description", "city",
        F.coalesce("size", F.lit(0)).alias("employee_count"), F.coalesce(mean, zero).alias("average_salary"),
        F.coalesce(F.col("highest").cast("double"), zero).alias("max_salary"),
        F.coalesce(F.col("lowest").cast("double"), zero).alias("min_salary"))


def top_earners(star: Star, detail: DataFrame | None = None) -> DataFrame:
    """A2 / V2: star detail by salary, highest first (NULL salaries first,
    as PostgreSQL orders DESC).  ``detail``: the star detail, if it is at
    hand."""
    return ((star_detail(star) if detail is None else detail).select(*DETAIL_COLUMNS)
            .orderBy(F.col("salary_amount").desc_nulls_first(), "employee_id", "company_id", "filename"))


def all_people(star: Star) -> DataFrame:
    """What several grouped statistics together need of all records."""
    return reduced_by_company(star.records("company_id", "employee_id", "salary_amount"), parts=star.parts())


def _people(star: Star) -> DataFrame:
    """What one of them needs."""
    return reduced(star.records("company_id", "employee_id", "salary_amount"), parts=star.parts())


def city_salary_stats(star: Star, people: DataFrame | None = None) -> DataFrame:
    """A3 / V3: per city, NULL city kept."""
    return salary_stats(_people(star) if people is None else people, star.companies, ["city"], company_count=True,
                        avg_name="average_salary", percentiles=MEDIAN, max_name="max_salary", parts=star.parts())


def activity_salary_stats(star: Star, people: DataFrame | None = None) -> DataFrame:
    """A4 / V4: per activity, NULL activity kept, no max."""
    return salary_stats(_people(star) if people is None else people, star.companies, ["activity_description"], company_count=True,
                        avg_name="average_salary", percentiles=MEDIAN, max_name=None, parts=star.parts())


def activity_keyword_rows(star: Star, keyword: str = "journal") -> DataFrame:
    """detail rows whose activity contains ``keyword``, salary desc."""
    df = star_detail(star, contains_ci("activity_description", keyword))
    return (df.select("employee_id", "full_name", "company_name", "activity_description",
                      "city", "filename", "salary_amount")
              .orderBy(F.col("salary_amount").desc_nulls_first(), "employee_id", "filename"))


def company_ilike_or(star: Star, name_term: str, activity_term: str) -> DataFrame:
    """companies whose name or activity matches (case-insensitive)."""
    return (star.companies.where(name_or_activity_ilike(name_term, activity_term))
            .select("company_id", "company_name", "activity_description", "city"))


def salary_band_rows(star: Star, lo=SALARY_BAND[0], hi=SALARY_BAND[1]) -> DataFrame:
    """F8: detail rows with salary in [lo, hi], salary desc."""
    df = star_detail(star, salary_between("salary_amount", lo, hi))
    return (df.select("full_name", "company_name", "city", "salary_amount", "filename")
              .orderBy(F.col("salary_amount").desc_nulls_first(), "full_name", "filename"))


def name_token(c: str = "full_name"):
    """The reference's "first_name": the LAST space-separated part."""
    return F.element_at(F.split(F.col(c), " "), -1)


def _token_stats(star: Star, min_count: int) -> DataFrame:
    df = employee_fact(star).withColumn("first_name", name_token())
    return (df.groupBy("first_name")
              .agg(F.count(F.lit(1)).alias("person_count"),
                   mean_round2("salary_amount").alias("avg_salary"))
              .where((F.col("person_count") >= min_count) & (F.col("first_name") != "")))


def first_name_stats_top(star: Star, min_count: int = NAME_TOKEN_MIN_COUNT,
                         limit: int = NAME_TOKEN_LIMIT) -> DataFrame:
    """Name tokens with >= min_count records, highest rounded mean first."""
    return (_token_stats(star, min_count)
            .orderBy(F.col("avg_salary").desc_nulls_first(), "first_name").limit(limit))


def first_name_stats_bottom(star: Star, min_count: int = NAME_TOKEN_MIN_COUNT,
                            limit: int = NAME_TOKEN_LIMIT) -> DataFrame:
    """As A16, lowest rounded mean first."""
    return (_token_stats(star, min_count)
            .orderBy(F.col("avg_salary").asc_nulls_last(), "first_name").limit(limit))


def name_token_stats(star: Star, tokens) -> DataFrame:
    """Count, rounded mean and rounded median for the listed tokens
    (case-sensitive IN) -- one pass: count, exact sum and median all come
    from the token's rank frame."""
    df = (employee_fact(star).withColumn("first_name", name_token())
          .where(F.col("first_name").isin(list(tokens))))
    rf = rank_frame(df.select("first_name", "salary_amount"), "salary_amount", ["first_name"])
    agg = rf.df.groupBy("first_name").agg(
        *quantile_exprs(MEDIAN), F.max("n_rows").alias("person_count"),
        F.max("n").alias("_n"), F.max("total").alias("_t"))
    # the exact sum at the precision of SUM(DECIMAL(15,2)), then HALF_UP
    mean2 = F.round(F.try_divide(F.col("_t").cast("decimal(25,2)"), F.col("_n")), 2).cast("double")
    return agg.select(
        "first_name", F.col("person_count").cast("long").alias("person_count"), mean2.alias("avg_salary"),
        # a median of cent values has at most 3 decimals: exact HALF_UP to 2
        F.round(quantile_value("median_salary").cast("decimal(18,3)"), 2).cast("double")
         .alias("median_salary")).orderBy(F.col("avg_salary").desc_nulls_first())


def top_income_shares(star: Star, groups=TOP_SHARE_GROUPS) -> DataFrame:
    """Top 0.1% / 1% / 10% by PERCENT_RANK over all records: rows,
    salary mass and share of the total.  One conditional-aggregate pass
    over the rank frame; every group row is present even when empty."""
    rf = rank_frame(star.records("salary_amount"), "salary_amount")
    pr = rf.percent_rank()
    aggs = []
    for i, (_, p) in enumerate(groups):
        hit = pr >= F.lit(p)
        aggs += [F.coalesce(F.sum(F.when(hit, F.col(F_))), F.lit(0)).alias(f"c{i}"),
                 F.sum(F.when(hit, F.col(V) * F.col(F_))).alias(f"s{i}")]
    aggs.append(F.max("total").alias("_total"))
    one = rf.df.agg(*aggs)
    stack = ", ".join(f"'{label}', c{i}, s{i}" for i, (label, _) in enumerate(groups))
    long = one.selectExpr(f"stack({len(groups)}, {stack}) AS (income_group, employee_count, mass)",
                          "_total")
    return long.select("income_group", F.col("employee_count").cast("long"),
                       F.col("mass").cast("double").alias("group_salary_mass"),
                       (ratio(F.col("mass"), F.col("_total")) * F.lit(100.0)).alias("percentage_of_total"))


def mean_median_ratio(star: Star) -> DataFrame:
    """Record count, mean, median and mean/median over all records
    (no salary floor), in one pass over the rank frame."""
    rf = rank_frame(star.records("salary_amount"), "salary_amount")
    one = rf.df.agg(*quantile_exprs(MEDIAN), F.max("n_rows").alias("rows"), F.max("n").alias("n"), F.max("total").alias("total"))
    return one.select(
        F.coalesce("rows", F.lit(0)).cast("long").alias("record_count"),
        ratio(F.col("total"), F.col("n")).alias("mean_salary"),
        rnd(quantile_value("median_salary"), PERCENTILE_DIGITS).alias("median_salary"))\
        .withColumn("mean_to_median_ratio", rnd(ratio(F.col("mean_salary"), F.col("median_salary")), INDEX_DIGITS))
