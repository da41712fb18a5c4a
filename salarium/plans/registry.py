"""Registry of named queries: Spark plan + independent DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs over the driver's tables
through the star adapter; ``ORACLE[name]`` is the same question in SQL over
the same tables (every key has one).  Column names match between the two.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salarium.functions.criteria import Criteria
from salarium.plans import dashboard, report, views
from salarium.plans.oracle import (DASHBOARD_EDGES, DASHBOARD_NAMES, REPORT_EDGES, REPORT_NAMES, SIZE_NAMES,
                                   SIZE_RANGES, avg_d, avg_round2, case_ordinal, dbl, digest, draw, label_of,
                                   like_ci, q, sql, std)
from salarium.sources.star import load_tpch_star

def decimals_to_double(df: DataFrame) -> DataFrame:
    """Results leave as DOUBLE, as the reference API converts Decimal to float."""
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


_STARS: dict = {}


def star_for(spark: SparkSession, sf_dir: str):
    """The adapter star for (session, folder), built once: its DataFrames
    are lazy plans over read-only files, like tables registered in a
    catalog, so every query reuses the file listing and schemas."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STARS:
        _STARS[key] = load_tpch_star(spark, sf_dir)
    return _STARS[key]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return decimals_to_double(fn(star_for(spark, sf_dir), spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# Parameters for the registered instances of parameterised queries.  They
# are chosen so that each predicate selects a real, non-trivial subset of
# the driver's tables (cities are NATION_k, activities are market segments,
# names are "Customer#..." and two-word part names).
COHORT = Criteria(city="nation_1", activity="mach", min_salary=10000, max_salary=90000)
ACTIVITY_KEYWORD = "mach"
ILIKE_NAME, ILIKE_ACTIVITY = "customer#0000001", "furn"
NAME_TOKENS = ("ring", "bolt")
CITY_A, CITY_B = "NATION_1", "NATION_2"

SAL = "s.salary_amount"
STAR_FROM = """FROM salary_records s
JOIN documents d ON s.document_id = d.document_id
JOIN companies c ON s.company_id = c.company_id
JOIN employees e ON s.employee_id = e.employee_id"""
DETAIL = ("e.employee_id, e.full_name, c.company_id, c.company_name, c.activity_description, "
          "c.city, CAST(s.salary_amount AS DOUBLE) AS salary_amount, d.filename")


def cohort_where(cr: Criteria) -> str:
    preds = []
    for term, col in ((cr.company_name, "c.company_name"), (cr.employee_name, "e.full_name"),
                      (cr.city, "c.city"), (cr.activity, "c.activity_description")):
        if term:
            preds.append(like_ci(col, term))
    lo, hi = cr.salary_range
    preds.append(f"s.salary_amount BETWEEN {lo} AND {hi}")
    return " AND ".join(preds)


# ---------------------------------------------------------------------------
# Report: grouped statistics
# ---------------------------------------------------------------------------

def _geo_sql(key: str) -> str:
    return sql(f"""SELECT c.{key},
  COUNT(DISTINCT c.company_id) AS company_count,
  COUNT(DISTINCT s.employee_id) AS employee_count,
  {avg_d(SAL)} AS avg_salary,
  {q(SAL, 0.5)} AS median_salary,
  {q(SAL, 0.25)} AS p25_salary,
  {q(SAL, 0.75)} AS p75_salary,
  {std(SAL)} AS stddev_salary,
  CAST(MAX(s.salary_amount) AS DOUBLE) AS max_salary,
  CAST(MIN(s.salary_amount) AS DOUBLE) AS min_salary
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
WHERE c.{key} IS NOT NULL AND s.salary_amount >= 1
GROUP BY c.{key}""")


@register("report_city_stats", _geo_sql("city"))
def _(star, spark, d):
    return report.report_city_stats(star)


@register("report_activity_stats", _geo_sql("activity_description"))
def _(star, spark, d):
    return report.report_activity_stats(star)


COMPANY_STATS_SQL = f"""SELECT c.company_name, c.city, c.activity_description,
  COUNT(DISTINCT s.employee_id) AS employee_count,
  {avg_d(SAL)} AS avg_salary,
  {q(SAL, 0.5)} AS median_salary,
  {q(SAL, 0.25)} AS p25_salary,
  {q(SAL, 0.75)} AS p75_salary,
  {std(SAL)} AS stddev_salary,
  CAST(MAX(s.salary_amount) AS DOUBLE) AS max_salary,
  CAST(MIN(s.salary_amount) AS DOUBLE) AS min_salary
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
WHERE s.salary_amount >= 1
GROUP BY c.company_name, c.city, c.activity_description
HAVING COUNT(DISTINCT s.employee_id) >= 10"""


@register("report_company_stats", sql(COMPANY_STATS_SQL))
def _(star, spark, d):
    return report.report_company_stats(star)


def _bucket_sql(edges, labels, source: str, label: str = "salary_range") -> str:
    o = case_ordinal("salary_amount", edges)
    return f"""SELECT {label_of('range_order', labels)} AS {label}, range_order, count FROM (
  SELECT CAST({o} AS BIGINT) AS range_order, COUNT(*) AS count FROM ({source}) GROUP BY 1)"""


REPORT_BUCKETS_SQL = _bucket_sql(REPORT_EDGES, REPORT_NAMES,
                                 "SELECT salary_amount FROM salary_records WHERE salary_amount >= 1")


@register("report_salary_buckets", sql(REPORT_BUCKETS_SQL))
def _(star, spark, d):
    return report.report_salary_buckets(star)


NATIONAL_SQL = "SELECT " + ",\n  ".join(
    [f"{q('salary_amount', p)} AS {k}" for k, p in report.NATIONAL_PERCENTILES.items()]
    + [f"{avg_d('salary_amount')} AS avg", "CAST(MIN(salary_amount) AS DOUBLE) AS min",
       "CAST(MAX(salary_amount) AS DOUBLE) AS max", "COUNT(*) AS record_count",
       "CAST(SUM(salary_amount) AS DOUBLE) AS total_salary"]) + \
    "\nFROM salary_records WHERE salary_amount >= 1"


@register("national_percentiles", sql(NATIONAL_SQL))
def _(star, spark, d):
    return report.national_percentiles(star)


def _size_case(x: str) -> str:
    parts = " ".join(f"WHEN {x} BETWEEN {lo} AND {hi} THEN {i}"
                     for i, (lo, hi) in enumerate(SIZE_RANGES, start=1))
    return f"CASE {parts} ELSE {len(SIZE_RANGES) + 1} END"


COMPANY_SIZES_SQL = f""", company_sizes AS (
  SELECT c.company_id, COUNT(DISTINCT s.employee_id) AS size
  FROM companies c JOIN salary_records s ON c.company_id = s.company_id
  WHERE s.salary_amount >= 1 GROUP BY c.company_id
), size_buckets AS (
  SELECT CAST({_size_case('size')} AS BIGINT) AS range_order, COUNT(*) AS company_count,
         CAST(SUM(size) AS BIGINT) AS employee_count
  FROM company_sizes GROUP BY 1
)"""


@register("company_size_distribution",
          sql(f"SELECT {label_of('range_order', SIZE_NAMES)} AS size_range, range_order, "
              "company_count, employee_count FROM size_buckets", COMPANY_SIZES_SQL))
def _(star, spark, d):
    return report.company_size_distribution(star)


DECILES_CTE = """, deciles AS (
  SELECT NTILE(10) OVER (ORDER BY salary_amount) AS decile, salary_amount
  FROM salary_records s WHERE s.salary_amount >= 1
)"""


@register("income_deciles", sql(f"""SELECT CAST(decile AS BIGINT) AS decile, COUNT(*) AS employee_count,
  CAST(SUM(salary_amount) AS DOUBLE) AS total_salary, {avg_d('salary_amount')} AS avg_salary,
  CAST(SUM(salary_amount) AS DOUBLE) / CAST((SELECT SUM(salary_amount) FROM deciles) AS DOUBLE) AS income_share
FROM deciles GROUP BY decile""", DECILES_CTE))
def _(star, spark, d):
    return report.income_deciles(star)


@register("salary_ntile", sql("""SELECT CAST(salary_amount AS DOUBLE) AS salary_amount,
  CAST(decile AS BIGINT) AS decile, COUNT(*) AS row_count FROM deciles GROUP BY 1, 2""", DECILES_CTE))
def _(star, spark, d):
    return report.salary_ntile(star)


# ---------------------------------------------------------------------------
# Views (V1 - V4) and ad-hoc analysis queries
# ---------------------------------------------------------------------------

@register("company_summary", sql(f"""SELECT c.company_id, c.company_name, c.activity_description, c.city,
  COUNT(DISTINCT s.employee_id) AS employee_count,
  COALESCE({avg_round2(SAL)}, 0.0) AS average_salary,
  COALESCE(CAST(MAX(s.salary_amount) AS DOUBLE), 0.0) AS max_salary,
  COALESCE(CAST(MIN(s.salary_amount) AS DOUBLE), 0.0) AS min_salary
FROM companies c LEFT JOIN salary_records s ON c.company_id = s.company_id
GROUP BY c.company_id, c.company_name, c.activity_description, c.city"""))
def _(star, spark, d):
    return views.company_summary(star)


@register("top_earners", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nORDER BY s.salary_amount DESC NULLS FIRST"))
def _(star, spark, d):
    return views.top_earners(star)


@register("city_salary_stats", sql(f"""SELECT c.city,
  COUNT(DISTINCT c.company_id) AS company_count, COUNT(DISTINCT s.employee_id) AS employee_count,
  {avg_d(SAL)} AS average_salary, {q(SAL, 0.5)} AS median_salary,
  CAST(MAX(s.salary_amount) AS DOUBLE) AS max_salary
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
GROUP BY c.city"""))
def _(star, spark, d):
    return views.city_salary_stats(star)


@register("activity_salary_stats", sql(f"""SELECT c.activity_description,
  COUNT(DISTINCT c.company_id) AS company_count, COUNT(DISTINCT s.employee_id) AS employee_count,
  {avg_d(SAL)} AS average_salary, {q(SAL, 0.5)} AS median_salary
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
GROUP BY c.activity_description"""))
def _(star, spark, d):
    return views.activity_salary_stats(star)


@register("activity_keyword_rows", sql(f"""SELECT e.employee_id, e.full_name, c.company_name,
  c.activity_description, c.city, d.filename, CAST(s.salary_amount AS DOUBLE) AS salary_amount
{STAR_FROM}
WHERE {like_ci('c.activity_description', ACTIVITY_KEYWORD)}
ORDER BY s.salary_amount DESC"""))
def _(star, spark, d):
    return views.activity_keyword_rows(star, ACTIVITY_KEYWORD)


@register("company_ilike_or", sql(f"""SELECT company_id, company_name, activity_description, city
FROM companies
WHERE company_name ILIKE '%{ILIKE_NAME}%' OR activity_description ILIKE '%{ILIKE_ACTIVITY}%'"""))
def _(star, spark, d):
    return views.company_ilike_or(star, ILIKE_NAME, ILIKE_ACTIVITY)


@register("salary_band_rows", sql(f"""SELECT e.full_name, c.company_name, c.city,
  CAST(s.salary_amount AS DOUBLE) AS salary_amount, d.filename
{STAR_FROM}
WHERE s.salary_amount BETWEEN 50000 AND 100000
ORDER BY s.salary_amount DESC"""))
def _(star, spark, d):
    return views.salary_band_rows(star)


TOKEN = "string_split(e.full_name, ' ')[-1]"
TOKEN_STATS_CTE = f""", paid_tokens AS (
  SELECT s.salary_amount, {TOKEN} AS token FROM salary_records s, employees e WHERE e.employee_id = s.employee_id
), token_stats AS (
  SELECT * FROM (SELECT token AS first_name, COUNT(*) AS person_count, {avg_round2('salary_amount')} AS avg_salary
                 FROM paid_tokens GROUP BY token)
  WHERE person_count > 19 AND first_name <> ''
)"""


@register("first_name_stats_top", sql("""SELECT first_name, person_count, avg_salary
FROM token_stats
ORDER BY avg_salary DESC, first_name LIMIT 100""", TOKEN_STATS_CTE))
def _(star, spark, d):
    return views.first_name_stats_top(star)


@register("first_name_stats_bottom", sql("""SELECT first_name, person_count, avg_salary
FROM token_stats
ORDER BY avg_salary ASC, first_name LIMIT 100""", TOKEN_STATS_CTE))
def _(star, spark, d):
    return views.first_name_stats_bottom(star)


_tok_list = ", ".join(f"'{t}'" for t in NAME_TOKENS)


@register("name_token_stats", sql(f"""SELECT {TOKEN} AS first_name, COUNT(*) AS person_count,
  {avg_round2('s.salary_amount')} AS avg_salary,
  CAST(ROUND(CAST(quantile_cont(CAST(s.salary_amount AS DOUBLE), 0.5) AS DECIMAL(18,3)), 2) AS DOUBLE) AS median_salary
FROM employees e JOIN salary_records s ON e.employee_id = s.employee_id
WHERE {TOKEN} IN ({_tok_list})
GROUP BY 1"""))
def _(star, spark, d):
    return views.name_token_stats(star, NAME_TOKENS)


@register("top_income_shares", sql("""SELECT name AS income_group, SUM(CASE WHEN place >= least THEN f ELSE 0 END)::BIGINT AS employee_count,
  CAST(SUM(CASE WHEN place >= least THEN v * f END) AS DOUBLE) AS group_salary_mass,
  CAST(SUM(CASE WHEN place >= least THEN v * f END) AS DOUBLE) / CAST(SUM(v * f) AS DOUBLE) * 100 AS percentage_of_total
FROM placed, (VALUES ('Top 0.1%', 0.999), ('Top 1%', 0.99), ('Top 10%', 0.9)) g(name, least)
GROUP BY name""", """, ties AS (
  SELECT salary_amount AS v, COUNT(*) AS f FROM salary_records GROUP BY salary_amount
), placed AS (
  SELECT v, f, (SUM(f) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - f)::DOUBLE / (SUM(f) OVER () - 1)::DOUBLE AS place FROM ties
)"""))
def _(star, spark, d):
    return views.top_income_shares(star)


@register("mean_median_ratio", sql(f"""SELECT COUNT(*) AS record_count, {avg_d('salary_amount')} AS mean_salary,
  {q('salary_amount', 0.5)} AS median_salary,
  ROUND({avg_d('salary_amount')} / NULLIF({q('salary_amount', 0.5)}, 0), 8) AS mean_to_median_ratio
FROM salary_records"""))
def _(star, spark, d):
    return views.mean_median_ratio(star)


# ---------------------------------------------------------------------------
# Search and dashboard (one cohort)
# ---------------------------------------------------------------------------

SEARCH_ORDER = ("s.salary_amount DESC NULLS FIRST, e.employee_id, c.company_id, d.filename, "
                "e.full_name, c.company_name, c.activity_description, c.city")


@register("search", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE {cohort_where(Criteria())}\n"
                        f"ORDER BY {SEARCH_ORDER} LIMIT 100"))
def _(star, spark, d):
    return dashboard.search(star, Criteria())


@register("search_filtered", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE {cohort_where(COHORT)}\n"
                                 f"ORDER BY {SEARCH_ORDER} LIMIT 100"))
def _(star, spark, d):
    return dashboard.search(star, COHORT)


def _dash_group_sql(key: str, with_max: bool, cr: Criteria, top: int = 20) -> str:
    mx = ",\n  CAST(MAX(s.salary_amount) AS DOUBLE) AS max_salary" if with_max else ""
    return sql(f"""SELECT c.{key}, COUNT(DISTINCT s.employee_id) AS employee_count,
  {avg_d(SAL)} AS avg_salary, {q(SAL, 0.5)} AS median_salary{mx}
{STAR_FROM}
WHERE {cohort_where(cr)} AND c.{key} IS NOT NULL
GROUP BY c.{key}
ORDER BY avg_salary DESC, c.{key} LIMIT {top}""")


@register("dashboard_city_stats", _dash_group_sql("city", True, COHORT))
def _(star, spark, d):
    return dashboard.dashboard_city_stats(star, COHORT)


@register("dashboard_activity_stats", _dash_group_sql("activity_description", False, COHORT))
def _(star, spark, d):
    return dashboard.dashboard_activity_stats(star, COHORT)


@register("dashboard_salary_buckets", sql(_bucket_sql(
    DASHBOARD_EDGES, DASHBOARD_NAMES,
    f"SELECT s.salary_amount {STAR_FROM} WHERE {cohort_where(COHORT)}")))
def _(star, spark, d):
    return dashboard.dashboard_salary_buckets(star, COHORT)


TOP_COMPANIES_SQL = f"""SELECT c.company_name, c.city, c.activity_description,
  COUNT(DISTINCT s.employee_id) AS employee_count, {avg_d(SAL)} AS avg_salary,
  CAST(MAX(s.salary_amount) AS DOUBLE) AS max_salary
{STAR_FROM}
WHERE {{where}}
GROUP BY c.company_name, c.city, c.activity_description
HAVING COUNT(DISTINCT s.employee_id) >= 3
ORDER BY avg_salary DESC, c.company_name, c.city, c.activity_description LIMIT {{top}}"""


@register("dashboard_top_companies", sql(TOP_COMPANIES_SQL.format(where=cohort_where(COHORT), top=20)))
def _(star, spark, d):
    return dashboard.dashboard_top_companies(star, COHORT)


# ---------------------------------------------------------------------------
# Report fact (S2), inequality (I1 - I8), Lorenz and running income
# ---------------------------------------------------------------------------

FACT_CTE = """, fact AS (
  SELECT s.salary_amount, c.city, c.activity_description, c.company_name, s.employee_id
  FROM salary_records s JOIN companies c ON s.company_id = c.company_id
  WHERE s.salary_amount >= 1
), x AS (SELECT CAST(salary_amount AS DOUBLE) AS v FROM fact)"""

GINI = """(SELECT ROUND(SUM((2 * i - n - 1) * w) / (MAX(n) * SUM(w)), 8) FROM (
    SELECT w, ROW_NUMBER() OVER (ORDER BY w) AS i, COUNT(*) OVER () AS n FROM (
      SELECT v - (SELECT CASE WHEN MIN(v) < 0 THEN MIN(v) ELSE 0 END FROM x) + 1e-7 AS w FROM x)))"""
HOOVER = """(SELECT ROUND(CASE WHEN COUNT(*) = 0 OR SUM(v) = 0 THEN 0
    ELSE SUM(ABS(v - (SELECT AVG(v) FROM x))) / (2 * SUM(v)) END, 8) FROM x)"""
ATKINSON = """(SELECT ROUND(CASE WHEN COUNT(*) = 0 THEN 0
    ELSE 1 - POWER(AVG(POWER(v / (SELECT AVG(v) FROM x WHERE v > 0), 0.5)), 2) END, 8) FROM x WHERE v > 0)"""
NAT_CTE = f""", nat AS ({NATIONAL_SQL})"""


@register("salary_fact", sql("""SELECT CAST(salary_amount AS DOUBLE) AS salary_amount, city,
  activity_description, company_name, employee_id FROM fact""", FACT_CTE))
def _(star, spark, d):
    from salarium.operators.joins import salary_fact
    return salary_fact(star)


@register("gini", sql(f"SELECT {GINI} AS gini", FACT_CTE))
def _(star, spark, d):
    return report.inequality_measures(star).select("gini")


@register("hoover", sql(f"SELECT {HOOVER} AS hoover", FACT_CTE))
def _(star, spark, d):
    return report.hoover(star)


@register("atkinson", sql(f"SELECT {ATKINSON} AS atkinson", FACT_CTE))
def _(star, spark, d):
    return report.atkinson(star)


@register("atkinson_log", sql("""SELECT ROUND(1 - EXP(AVG(LN(v))) / AVG(v), 8) AS atkinson
FROM (SELECT CAST(salary_amount AS DOUBLE) AS v FROM fact WHERE salary_amount > 0)""", FACT_CTE))
def _(star, spark, d):
    """Atkinson index at epsilon 1."""
    return report.atkinson(star, 1)


def inequality_sql(group: str) -> str:
    return sql(f"""SELECT {group}, COUNT(*) AS record_count,
  ROUND(SUM((2 * i - n - 1) * w) / (MAX(n) * SUM(w)), 8) AS gini,
  ROUND(CASE WHEN SUM(v) = 0 THEN 0 ELSE SUM(ABS(v - mean)) / (2 * SUM(v)) END, 8) AS hoover,
  ROUND(CASE WHEN COUNT(CASE WHEN v > 0 THEN 1 END) = 0 THEN 0
    ELSE 1 - POWER(AVG(CASE WHEN v > 0 THEN POWER(v / pmean, 0.5) END), 2) END, 8) AS atkinson
FROM (
  SELECT g.{group}, g.v, g.v - CASE WHEN st.mn < 0 THEN st.mn ELSE 0 END + 1e-7 AS w,
         ROW_NUMBER() OVER (PARTITION BY g.{group} ORDER BY g.v) AS i, st.n, st.mean, st.pmean
  FROM gx g JOIN st ON g.{group} = st.{group})
GROUP BY {group}""", FACT_CTE + f""", gx AS (
  SELECT {group}, CAST(salary_amount AS DOUBLE) AS v FROM fact WHERE {group} IS NOT NULL
), st AS (
  SELECT {group}, COUNT(*) AS n, MIN(v) AS mn, AVG(v) AS mean, AVG(CASE WHEN v > 0 THEN v END) AS pmean
  FROM gx GROUP BY {group}
)""")


@register("inequality_by_group", inequality_sql("city"))
def _(star, spark, d):
    return report.inequality_by_group(star, "city")


@register("inequality_by_activity", inequality_sql("activity_description"))
def _(star, spark, d):
    return report.inequality_by_group(star, "activity_description")


CURVE_CTE = FACT_CTE + """, curve AS (
  SELECT ROW_NUMBER() OVER (ORDER BY salary_amount) - 1 AS i, salary_amount,
         SUM(salary_amount) OVER (ORDER BY salary_amount ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         COUNT(*) OVER () AS n, SUM(salary_amount) OVER () AS t
  FROM fact
)"""


@register("lorenz_curve", sql("""SELECT i AS point_index,
  CASE WHEN n > 1 THEN CAST(i AS DOUBLE) / (n - 1) ELSE 0.0 END AS x,
  CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS y
FROM (SELECT *, LEAD(salary_amount) OVER (ORDER BY i) AS following FROM curve)
WHERE i = 0 OR following IS NULL OR following <> salary_amount""", CURVE_CTE))
def _(star, spark, d):
    return report.lorenz_curve(star)


@register("lorenz_points_100", sql("""SELECT i AS point_index,
  CASE WHEN n > 1 THEN CAST(i AS DOUBLE) / (n - 1) ELSE 0.0 END AS x,
  CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS y
FROM curve
WHERE i IN (SELECT DISTINCT (g.j * (m.nn - 1)) // 100 FROM range(0, 101) g(j), (SELECT COUNT(*) AS nn FROM fact) m)""",
                                   CURVE_CTE))
def _(star, spark, d):
    """A chart's 101 points of the curve (the number of points is the feature)."""
    return report.lorenz_curve(star, 100)


@register("running_income", sql("""SELECT i + 1 AS position,
  CASE WHEN n > 1 THEN CAST(i AS DOUBLE) / (n - 1) ELSE 0.0 END AS x,
  CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS cumulative_share
FROM curve""", CURVE_CTE))
def _(star, spark, d):
    return report.running_income(star)


@register("global_stddev", sql(f"SELECT {std('salary_amount')} AS stddev_salary FROM fact", FACT_CTE))
def _(star, spark, d):
    return report.global_stddev(star)


PRANK_CTE = """, pr AS (
  SELECT employee_id, document_id, CAST(salary_amount AS DOUBLE) AS salary_amount,
         PERCENT_RANK() OVER (ORDER BY salary_amount) AS percent_rank
  FROM salary_records
)"""


RECORD_KEY = "COALESCE(employee_id::VARCHAR, 'null') || '|' || COALESCE(document_id::VARCHAR, 'null')"


@register("salary_ntile_rows", sql(f"""SELECT employee_id, document_id, salary_amount::DOUBLE AS salary_amount,
  NTILE(10) OVER (ORDER BY salary_amount, {digest(15, "'42'", "'order'", "salary_amount::VARCHAR", RECORD_KEY)}, {RECORD_KEY}) AS decile
FROM salary_records WHERE salary_amount >= 1"""))
def _(star, spark, d):
    return report.salary_ntile_rows(star)


@register("global_percent_rank", sql("SELECT * FROM pr", PRANK_CTE))
def _(star, spark, d):
    return report.global_percent_rank(star)


@register("percent_rank_at_least", sql("SELECT * FROM pr WHERE percent_rank >= 0.99", PRANK_CTE))
def _(star, spark, d):
    return report.percent_rank_at_least(star, 0.99)


def _ratio(a: str, b: str) -> str:
    return f"ROUND({a} / NULLIF({b}, 0), 8)"


@register("percentile_ratios", sql(f"""SELECT {_ratio('p90', 'p10')} AS p90_p10, {_ratio('p75', 'p25')} AS p75_p25,
  {_ratio('p99', 'p50')} AS p99_p50,
  CASE WHEN p50 > 0 THEN {_ratio('avg', 'p50')} ELSE 0.0 END AS mean_median_ratio FROM nat""", NAT_CTE))
def _(star, spark, d):
    return report.percentile_ratios(star)


@register("top1_threshold", sql("SELECT p99 AS top1_min_salary FROM nat", NAT_CTE))
def _(star, spark, d):
    return report.top1_threshold(star)


def _share(cond: str) -> str:
    return (f"ROUND(CAST(SUM(CASE WHEN {cond} THEN salary_amount END) AS DOUBLE) / "
            f"CAST(SUM(salary_amount) AS DOUBLE) * 100, 8)")


@register("income_concentration", sql(f"""SELECT {_share('decile = 10')} AS top_10_percent,
  {_share('decile >= 9')} AS top_20_percent, {_share('decile <= 5')} AS bottom_50_percent
FROM deciles""", DECILES_CTE))
def _(star, spark, d):
    return report.income_concentration(star)


PCT_KEYS = list(report.NATIONAL_PERCENTILES)
PCT_TABLE_SQL = "\nUNION ALL\n".join(
    f"SELECT CAST({i + 1} AS BIGINT) AS ord, '{k}' AS percentile_key, "
    f"CAST({report.NATIONAL_PERCENTILES[k]} AS DOUBLE) AS percentile, {k} AS value, "
    + ("CAST(NULL AS DOUBLE)" if i == 0 else _ratio(k, PCT_KEYS[i - 1]))
    + " AS ratio_to_previous, avg AS mean_salary FROM nat"
    for i, k in enumerate(PCT_KEYS))


@register("page_percentiles", sql(PCT_TABLE_SQL, NAT_CTE))
def _(star, spark, d):
    return report.page_percentiles(star)


@register("percentile_step_ratios", sql(
    f"SELECT percentile_key AS to_key, ratio_to_previous FROM ({PCT_TABLE_SQL}) WHERE ord > 1", NAT_CTE))
def _(star, spark, d):
    return report.percentile_step_ratios(star)


# ---------------------------------------------------------------------------
# Report pages
# ---------------------------------------------------------------------------

@register("report_summary", sql(f"""SELECT record_count, total_salary, avg AS mean_salary, p50 AS median_salary,
  CASE WHEN p50 > 0 THEN {_ratio('avg', 'p50')} ELSE 0.0 END AS mean_median_ratio,
  min AS min_salary, max AS max_salary, ROUND(max - min, 2) AS salary_range,
  (SELECT {std('salary_amount')} FROM fact) AS stddev_salary,
  p10, p25, p50, p75, p90, p95, p99,
  {_ratio('p90', 'p10')} AS p90_p10, {_ratio('p75', 'p25')} AS p75_p25, {_ratio('p99', 'p50')} AS p99_p50,
  {GINI} AS gini, {HOOVER} AS hoover
FROM nat""", FACT_CTE + NAT_CTE))
def _(star, spark, d):
    return report.report_summary(star)


@register("page_salary_distribution", sql("""SELECT salary_range, range_order, count,
  CAST(count AS DOUBLE) / CAST(SUM(count) OVER () AS DOUBLE) * 100 AS percentage
FROM (""" + REPORT_BUCKETS_SQL + ")"))
def _(star, spark, d):
    return report.page_salary_distribution(star)


@register("page_lorenz", sql(f"""SELECT {GINI} AS gini, {HOOVER} AS hoover, {ATKINSON} AS atkinson,
  {_ratio('p90', 'p10')} AS p90_p10, {_ratio('p75', 'p25')} AS p75_p25, {_ratio('p99', 'p50')} AS p99_p50,
  p99 AS top1_min_salary FROM nat""", FACT_CTE + NAT_CTE))
def _(star, spark, d):
    return report.page_lorenz(star)


@register("page_decile_shares", sql("""SELECT CAST(decile AS BIGINT) AS decile, COUNT(*) AS employee_count,
  CAST(SUM(salary_amount) AS DOUBLE) AS total_salary,
  ROUND(CAST(SUM(salary_amount) AS DOUBLE) / CAST((SELECT SUM(salary_amount) FROM deciles) AS DOUBLE) * 100, 8)
    AS income_share_pct
FROM deciles GROUP BY decile""", DECILES_CTE))
def _(star, spark, d):
    return report.page_decile_shares(star)


@register("page_company_sizes", sql(f"""SELECT {label_of('range_order', SIZE_NAMES)} AS size_range,
  range_order, company_count, employee_count,
  CAST(SUM(company_count) OVER () AS BIGINT) AS total_companies,
  CAST(SUM(employee_count) OVER () AS BIGINT) AS total_employees,
  ROUND(CAST(SUM(employee_count) OVER () AS DOUBLE) / CAST(SUM(company_count) OVER () AS DOUBLE), 4)
    AS avg_company_size
FROM size_buckets""", COMPANY_SIZES_SQL))
def _(star, spark, d):
    return report.page_company_sizes(star)


def _geo_cte(key: str) -> str:
    body = _geo_sql(key)[len(sql("")):].strip()
    return f", geo AS ({body})"


@register("page_top_cities_headcount", sql("""SELECT city, employee_count, company_count, avg_salary,
  CAST(TRUNC(avg_salary) AS BIGINT) AS avg_salary_label
FROM geo ORDER BY employee_count DESC, city LIMIT 15""", _geo_cte("city")))
def _(star, spark, d):
    return report.page_top_cities_headcount(star)


@register("page_top_cities_salary", sql("""SELECT city, avg_salary, employee_count, company_count
FROM geo WHERE employee_count >= 100 ORDER BY avg_salary DESC, city LIMIT 15""", _geo_cte("city")))
def _(star, spark, d):
    return report.page_top_cities_salary(star)


SHORT50 = ("CASE WHEN length(activity_description) > 50 THEN substring(activity_description, 1, 50) || '...' "
           "ELSE activity_description END")


@register("page_top_activities_headcount", sql(f"""SELECT activity_description, {SHORT50} AS short_name,
  employee_count, company_count, avg_salary
FROM geo ORDER BY employee_count DESC, activity_description LIMIT 15""", _geo_cte("activity_description")))
def _(star, spark, d):
    return report.page_top_activities_headcount(star)


@register("page_top_activities_salary", sql(f"""SELECT activity_description, {SHORT50} AS short_name,
  avg_salary, employee_count, company_count, median_salary
FROM geo WHERE employee_count >= 100 ORDER BY avg_salary DESC, activity_description LIMIT 15""",
                                            _geo_cte("activity_description")))
def _(star, spark, d):
    return report.page_top_activities_salary(star)


LARGEST = "(SELECT * FROM geo ORDER BY employee_count DESC, city LIMIT 15)"


@register("page_city_mean_median", sql(f"""SELECT city, avg_salary, median_salary, employee_count,
  {_ratio('avg_salary', 'median_salary')} AS mean_median_ratio FROM {LARGEST}""", _geo_cte("city")))
def _(star, spark, d):
    return report.page_city_mean_median(star)


@register("page_city_cv", sql(f"""SELECT city, stddev_salary, avg_salary, employee_count,
  {_ratio('stddev_salary', 'avg_salary')} AS cv FROM {LARGEST}""", _geo_cte("city")))
def _(star, spark, d):
    return report.page_city_cv(star)


@register("page_city_captions", sql(f"""SELECT city,
  CASE WHEN a >= 1000000 THEN printf('%.2fM', a / 1000000) WHEN a >= 1000 THEN printf('%.1fK', a / 1000) ELSE printf('%.0f', a) END AS magnitude,
  CASE WHEN a >= 1000000 THEN printf('%.1fM MAD', a / 1000000) WHEN a >= 1000 THEN printf('%.0fK MAD', a / 1000) ELSE printf('%.0f MAD', a) END AS axis_label,
  format('Companies: {{:,}} | Avg Salary: {{:,}} MAD', n, floor(a)::BIGINT) AS caption
FROM (SELECT c.city, COUNT(DISTINCT c.company_id) AS n, {avg_d(SAL)} AS a FROM companies c JOIN salary_records s ON c.company_id = s.company_id
  WHERE s.salary_amount >= 1 AND c.city IS NOT NULL GROUP BY c.city)"""))
def _(star, spark, d):
    return report.page_city_captions(star)


@register("page_city_iqr", sql(f"""SELECT city, p25_salary, p75_salary, employee_count,
  ROUND(p75_salary - p25_salary, 6) AS iqr, {_ratio('p75_salary', 'p25_salary')} AS iqr_ratio
FROM {LARGEST}""", _geo_cte("city")))
def _(star, spark, d):
    return report.page_city_iqr(star)


COMPANY_LABELS = ("COALESCE(NULLIF(city, ''), 'Unknown') AS city_label, "
                  "CASE WHEN length(activity_description) > 40 THEN substring(activity_description, 1, 37) || '...' "
                  "ELSE activity_description END AS activity_label")
COMPANY_CTE = f", comp AS ({COMPANY_STATS_SQL})"


@register("page_top_companies_headcount", sql(f"""SELECT company_name, city, activity_description, {COMPANY_LABELS},
  employee_count, avg_salary, CAST(TRUNC(avg_salary) AS BIGINT) AS avg_salary_label
FROM comp ORDER BY employee_count DESC, company_name, city, activity_description LIMIT 15""", COMPANY_CTE))
def _(star, spark, d):
    return report.page_top_companies_headcount(star)


@register("page_top_companies_salary", sql(f"""SELECT company_name, city, activity_description, {COMPANY_LABELS},
  avg_salary, employee_count, median_salary
FROM comp WHERE employee_count >= 30
ORDER BY avg_salary DESC, company_name, city, activity_description LIMIT 15""", COMPANY_CTE))
def _(star, spark, d):
    return report.page_top_companies_salary(star)


@register("size_vs_salary_corr", sql(f"""SELECT COUNT(*) AS company_count,
  ROUND(corr(CAST(size AS DOUBLE), avg_salary), 8) AS correlation FROM (
  SELECT c.company_id, COUNT(DISTINCT s.employee_id) AS size, {avg_d(SAL)} AS avg_salary
  FROM companies c JOIN salary_records s ON c.company_id = s.company_id
  WHERE s.salary_amount >= 1 GROUP BY c.company_id)"""))
def _(star, spark, d):
    return report.size_vs_salary_corr(star)


@register("compare_two_cities", sql(f"""SELECT {label_of('range_order', REPORT_NAMES)} AS salary_range,
  range_order, count_a, count_b FROM (
  SELECT CAST({case_ordinal('s.salary_amount', REPORT_EDGES)} AS BIGINT) AS range_order,
         COUNT(CASE WHEN c.city = '{CITY_A}' THEN 1 END) AS count_a,
         COUNT(CASE WHEN c.city = '{CITY_B}' THEN 1 END) AS count_b
  FROM companies c JOIN salary_records s ON c.company_id = s.company_id
  WHERE s.salary_amount >= 1 AND c.city IN ('{CITY_A}', '{CITY_B}')
  GROUP BY 1)"""))
def _(star, spark, d):
    return report.compare_two_cities(star, CITY_A, CITY_B)


# ---------------------------------------------------------------------------
# Scans, filters and joins
# ---------------------------------------------------------------------------

@register("city_list", sql("SELECT DISTINCT city FROM companies WHERE city IS NOT NULL ORDER BY city"))
def _(star, spark, d):
    return star.companies.where(F.col("city").isNotNull()).select("city").distinct().orderBy("city")


@register("star_detail", sql(f"SELECT {DETAIL}\n{STAR_FROM}"))
def _(star, spark, d):
    from salarium.operators.joins import DETAIL_COLUMNS, star_detail
    return star_detail(star).select(*DETAIL_COLUMNS)


FILTER_COMPANY = "customer#00000001"


@register("filter_text_contains", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE {like_ci('c.company_name', FILTER_COMPANY)}"))
def _(star, spark, d):
    from salarium.functions.criteria import contains_ci
    from salarium.operators.joins import DETAIL_COLUMNS, star_detail
    return star_detail(star, contains_ci("company_name", FILTER_COMPANY)).select(*DETAIL_COLUMNS)


@register("filter_salary_between", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE s.salary_amount BETWEEN 50000 AND 60000"))
def _(star, spark, d):
    from salarium.functions.criteria import salary_between
    from salarium.operators.joins import DETAIL_COLUMNS, star_detail
    return star_detail(star, salary_between("salary_amount", 50000, 60000)).select(*DETAIL_COLUMNS)


@register("cohort_filter", sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE {cohort_where(COHORT)}"))
def _(star, spark, d):
    from salarium.operators.joins import DETAIL_COLUMNS
    return dashboard.cohort(star, COHORT).select(*DETAIL_COLUMNS)


@register("filter_salary_floor", sql("""SELECT employee_id, document_id, CAST(salary_amount AS DOUBLE) AS salary_amount
FROM salary_records WHERE salary_amount >= 1"""))
def _(star, spark, d):
    return report.floor_records(star)


@register("filter_not_null_dim", sql("""SELECT company_id, company_name, activity_description, city
FROM companies WHERE city IS NOT NULL AND activity_description IS NOT NULL"""))
def _(star, spark, d):
    return star.companies.where(F.col("city").isNotNull() & F.col("activity_description").isNotNull())


@register("having_min_count", sql("""SELECT c.company_id, COUNT(DISTINCT s.employee_id) AS employee_count
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
WHERE s.salary_amount >= 1
GROUP BY c.company_id HAVING COUNT(DISTINCT s.employee_id) >= 30"""))
def _(star, spark, d):
    from salarium.operators.joins import company_sizes
    return company_sizes(star, 1).where(F.col("size") >= 30).select("company_id", F.col("size").alias("employee_count"))


@register("filter_nonblank_token", sql(f"""SELECT {TOKEN} AS first_name, COUNT(*) AS person_count
FROM employees e JOIN salary_records s ON e.employee_id = s.employee_id
GROUP BY 1 HAVING {TOKEN} != ''"""))
def _(star, spark, d):
    from salarium.operators.joins import employee_fact
    return (employee_fact(star).withColumn("first_name", views.name_token())
            .groupBy("first_name").agg(F.count(F.lit(1)).alias("person_count"))
            .where(F.col("first_name") != ""))


@register("name_token_in", sql(f"""SELECT e.employee_id, e.full_name, {TOKEN} AS first_name,
  CAST(s.salary_amount AS DOUBLE) AS salary_amount
FROM employees e JOIN salary_records s ON e.employee_id = s.employee_id
WHERE {TOKEN} IN ({_tok_list})"""))
def _(star, spark, d):
    from salarium.operators.joins import employee_fact
    return (employee_fact(star).withColumn("first_name", views.name_token())
            .where(F.col("first_name").isin(list(NAME_TOKENS)))
            .select("employee_id", "full_name", "first_name", "salary_amount"))


@register("company_fact_join", sql("""SELECT s.employee_id, s.company_id, s.document_id,
  CAST(s.salary_amount AS DOUBLE) AS salary_amount, c.company_name, c.activity_description, c.city
FROM companies c JOIN salary_records s ON c.company_id = s.company_id"""))
def _(star, spark, d):
    from salarium.operators.joins import company_fact
    return company_fact(star)


@register("employee_fact_join", sql("""SELECT s.employee_id, s.document_id,
  CAST(s.salary_amount AS DOUBLE) AS salary_amount, e.full_name
FROM employees e JOIN salary_records s ON e.employee_id = s.employee_id"""))
def _(star, spark, d):
    from salarium.operators.joins import employee_fact
    return employee_fact(star)


@register("company_left_fact", sql("""SELECT c.company_id, c.company_name, c.activity_description, c.city,
  s.employee_id, CAST(s.salary_amount AS DOUBLE) AS salary_amount
FROM companies c LEFT JOIN salary_records s ON c.company_id = s.company_id"""))
def _(star, spark, d):
    from salarium.operators.joins import company_left_fact
    return company_left_fact(star)


@register("share_of_total", sql("""SELECT c.city, CAST(SUM(s.salary_amount) AS DOUBLE) AS salary_mass,
  CAST(SUM(s.salary_amount) AS DOUBLE) / CAST((SELECT SUM(salary_amount) FROM salary_records) AS DOUBLE) * 100
    AS percentage_of_total
FROM companies c JOIN salary_records s ON c.company_id = s.company_id
GROUP BY c.city"""))
def _(star, spark, d):
    from salarium.operators.joins import company_fact, with_share_of_total
    per = company_fact(star).groupBy("city").agg(F.sum("salary_amount").alias("salary_mass"))
    return with_share_of_total(per, "salary_mass", star.records("salary_amount"), "salary_amount")


FUZZY_TERM = "widgets"


def _trgm_sql(col: str) -> str:
    words = (f"list_filter(string_split(trim(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), "
             "lambda w: w <> '')")
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            "range(1, length('  ' || w || ' ') - 1), lambda i: substring('  ' || w || ' ', i, 3)))))")


def _fuzzy_sql(table: str, key: str, col: str, term: str) -> str:
    return sql(f"""SELECT {key}, {col}, similarity FROM (
  SELECT {key}, {col},
    ROUND(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
      ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 8) AS similarity
  FROM (SELECT {key}, {col}, {_trgm_sql(col)} AS a, {_trgm_sql("'" + term + "'")} AS b FROM {table}))
WHERE similarity >= 0.3""")


@register("fuzzy_name_search", _fuzzy_sql("employees", "employee_id", "full_name", FUZZY_TERM))
def _(star, spark, d):
    from salarium.operators.fuzzy import fuzzy_search
    return fuzzy_search(star.employees, "full_name", FUZZY_TERM).select("employee_id", "full_name", "similarity")


@register("fuzzy_company_search", _fuzzy_sql("companies", "company_id", "company_name", "customer 000000042"))
def _(star, spark, d):
    from salarium.operators.fuzzy import fuzzy_search
    return fuzzy_search(star.companies, "company_name", "customer 000000042").select("company_id", "company_name", "similarity")


@register("fuzzy_activity_search", _fuzzy_sql("companies", "company_id", "activity_description", "machine"))
def _(star, spark, d):
    from salarium.operators.fuzzy import fuzzy_search
    return fuzzy_search(star.companies, "activity_description", "machine").select("company_id", "activity_description", "similarity")


def _grams_sql(table: str, key: str, col: str) -> str:
    """One row a gram of each different text, with the text's smallest key."""
    return (f"SELECT key, len(grams) AS n, unnest(grams) AS gram FROM (SELECT min({key}) AS key, {_trgm_sql(col)} AS grams "
            f"FROM {table} WHERE {col} IS NOT NULL GROUP BY {col}) WHERE len(grams) > 0")


def _pairs_sql(threshold: float, left: str, right: str | None = None) -> str:
    """Every pair of sets that share a gram at all, by counting."""
    return f"""SELECT left_key, right_key, similarity FROM (
  SELECT a.key AS left_key, b.key AS right_key, ROUND(COUNT(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - COUNT(*))::DOUBLE, 8) AS similarity
  FROM ({left}) a JOIN ({right or left}) b ON a.gram = b.gram {"" if right else "AND a.key < b.key"} GROUP BY a.key, b.key)
WHERE similarity >= {threshold}"""


COMPANY_GRAMS = _grams_sql("companies", "company_id", "company_name")
PERSON_GRAMS = _grams_sql("employees", "employee_id", "full_name")


@register("fuzzy_company_pairs", sql(_pairs_sql(0.75, COMPANY_GRAMS)))
def _(star, spark, d):
    """Duplicate employers: names of which three grams in four agree."""
    from salarium.operators.fuzzy_join import fuzzy_pairs
    return fuzzy_pairs(star.companies, "company_id", "company_name", 0.75)


@register("fuzzy_person_links", sql(f"""SELECT e.employee_id, c.class_key, c.class_size, COALESCE(l.links, 0) AS links
FROM employees e JOIN (SELECT full_name, MIN(employee_id) AS class_key, COUNT(*) AS class_size FROM employees GROUP BY 1) c
  ON e.full_name = c.full_name
LEFT JOIN (SELECT key, COUNT(*) AS links FROM (SELECT unnest([left_key, right_key]) AS key FROM pairs) GROUP BY key) l ON l.key = c.class_key""",
    f", pairs AS ({_pairs_sql(0.6, PERSON_GRAMS)})"))
def _(star, spark, d):
    """For every person the class of equal names and the number of other,
    similar names."""
    from salarium.operators.fuzzy_join import fuzzy_pairs, link_counts, members
    pairs = fuzzy_pairs(star.employees, "employee_id", "full_name", 0.6)
    return link_counts(pairs, members(star.employees, "employee_id", "full_name"), "employee_id")


@register("fuzzy_employer_match", sql(_pairs_sql(0.7, COMPANY_GRAMS, _grams_sql("supplier", "s_suppkey", "replace(s_name, 'Supplier', 'Customer')"))))
def _(star, spark, d):
    """A second register of names (the suppliers, spelled as employers)
    matched with the employers: a join of two tables."""
    from salarium.operators.fuzzy_join import fuzzy_pairs
    other = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.expr("replace(s_name, 'Supplier', 'Customer')").alias("name"))
    return fuzzy_pairs(star.companies, "company_id", "company_name", 0.7, other, "s_suppkey", "name")


# ---------------------------------------------------------------------------
# Dashboard bundle and chart datasets
# ---------------------------------------------------------------------------

def _bundle_sql(cr: Criteria) -> str:
    w = cohort_where(cr)
    city = _dash_group_sql("city", True, cr)[len(sql("")):].strip()
    act = _dash_group_sql("activity_description", False, cr)[len(sql("")):].strip()
    buckets = _bucket_sql(DASHBOARD_EDGES, DASHBOARD_NAMES,
                          f"SELECT s.salary_amount {STAR_FROM} WHERE {w}")
    comps = TOP_COMPANIES_SQL.format(where=w, top=20)
    return sql(f"""SELECT 'city_stats' AS dataset, city AS label, city, CAST(NULL AS VARCHAR) AS activity_description,
  employee_count, avg_salary, median_salary, max_salary, CAST(NULL AS BIGINT) AS record_count FROM ({city})
UNION ALL
SELECT 'activity_stats', activity_description, NULL, activity_description, employee_count, avg_salary,
  median_salary, NULL, NULL FROM ({act})
UNION ALL
SELECT 'salary_distribution', salary_range, NULL, NULL, NULL, NULL, NULL, NULL, count FROM ({buckets})
UNION ALL
SELECT 'top_companies', company_name, city, activity_description, employee_count, avg_salary, NULL,
  max_salary, NULL FROM ({comps})""")


@register("stats_bundle", _bundle_sql(COHORT))
def _(star, spark, d):
    return dashboard.stats_bundle_long(star, COHORT)


def _chart_sql(cr: Criteria) -> str:
    w = cohort_where(cr)
    city = _dash_group_sql("city", True, cr, 15)[len(sql("")):].strip()
    act = _dash_group_sql("activity_description", False, cr, 15)[len(sql("")):].strip()
    comps = TOP_COMPANIES_SQL.format(where=w, top=15)

    def cut(c):
        return f"CASE WHEN length({c}) > 40 THEN substring({c}, 1, 40) || '...' ELSE {c} END"
    return sql(f"""SELECT 'city' AS chart, city AS label, avg_salary, employee_count FROM ({city})
UNION ALL SELECT 'activity', {cut('activity_description')}, avg_salary, employee_count FROM ({act})
UNION ALL SELECT 'company', {cut('company_name')}, avg_salary, employee_count FROM ({comps})""")


@register("chart_top15", _chart_sql(COHORT))
def _(star, spark, d):
    return dashboard.chart_top15(star, COHORT)


# ---------------------------------------------------------------------------
# Table jobs
# ---------------------------------------------------------------------------

ROW_COUNTS_SQL = sql("""SELECT 'Companies:' AS table_name, COUNT(*) AS row_count FROM companies
UNION ALL SELECT 'Employees:', COUNT(*) FROM employees
UNION ALL SELECT 'Documents:', COUNT(*) FROM documents
UNION ALL SELECT 'Salary Records:', COUNT(*) FROM salary_records""")


@register("table_row_counts", ROW_COUNTS_SQL)
def _(star, spark, d):
    from salarium.plans.jobs import table_row_counts
    return table_row_counts(star)


@register("reload_tables", sql("""SELECT 'Companies:' AS table_name, COUNT(*) AS row_count, SUM(company_id)::DOUBLE AS content_sum FROM companies
UNION ALL SELECT 'Employees:', COUNT(*), SUM(employee_id)::DOUBLE FROM employees
UNION ALL SELECT 'Documents:', COUNT(*), SUM(document_id)::DOUBLE FROM documents
UNION ALL SELECT 'Salary Records:', COUNT(*), CAST(SUM(salary_amount) AS DOUBLE) FROM salary_records"""))
def _(star, spark, d):
    from salarium.plans.jobs import reload_and_count
    return reload_and_count(spark, star)


@register("metric_value_stats", sql(f"""SELECT 'Avg Salary' AS metric, {avg_round2('salary_amount')} AS value FROM salary_records
UNION ALL SELECT 'Median Salary', {q('salary_amount', 0.5)} FROM salary_records
UNION ALL SELECT 'Max Salary', CAST(MAX(salary_amount) AS DOUBLE) FROM salary_records"""))
def _(star, spark, d):
    from salarium.plans.jobs import metric_value_stats
    return metric_value_stats(star)


@register("document_mass_backfill", sql("""SELECT d.document_id, d.filename, d.company_id, d.employee_count,
  CAST(COALESCE(m.mass, 0) AS DOUBLE) AS total_salary_mass
FROM documents d LEFT JOIN (SELECT document_id, SUM(salary_amount) AS mass FROM salary_records GROUP BY 1) m
  ON d.document_id = m.document_id"""))
def _(star, spark, d):
    from salarium.plans.jobs import document_mass_backfill
    return document_mass_backfill(star)


def _heads_sql(group: str) -> str:
    return (f"SELECT COUNT(*), SUM(n)::DOUBLE FROM (SELECT c.{group}, COUNT(DISTINCT s.employee_id) AS n "
            f"FROM companies c JOIN salary_records s ON c.company_id = s.company_id GROUP BY 1)")


@register("refresh_summary_tables", sql(f"""SELECT 'company_summary' AS table_name, (SELECT COUNT(*) FROM companies) AS row_count,
  (SELECT SUM(n)::DOUBLE FROM (SELECT s.company_id, COUNT(DISTINCT s.employee_id) AS n
   FROM companies c JOIN salary_records s ON c.company_id = s.company_id GROUP BY 1)) AS content_sum
UNION ALL SELECT 'top_earners', COUNT(*), CAST(SUM(s.salary_amount) AS DOUBLE) {STAR_FROM}
UNION ALL SELECT 'city_salary_stats', * FROM ({_heads_sql("city")})
UNION ALL SELECT 'activity_salary_stats', * FROM ({_heads_sql("activity_description")})"""))
def _(star, spark, d):
    from salarium.plans.jobs import refresh_summary_tables
    return refresh_summary_tables(spark, star)


def _refreshed(star, spark, name: str) -> DataFrame:
    """A summary table after three batches: most records, the others together
    with some wrong ones, and a batch that withdraws the wrong ones."""
    from salarium.plans.refresh import refresh, summary_table
    from salarium.sources.sinks import scratch_path
    base = scratch_path(spark, "refresh")
    rows = star.records("company_id", "employee_id", "document_id", "salary_amount")
    part = F.pmod("document_id", F.lit(10))
    wrong = rows.where(part == 3).withColumn("salary_amount", (F.col("salary_amount") + 1).cast("decimal(15,2)"))
    refresh(spark, base, rows.where((part < 7) | part.isNull()), star.companies)
    refresh(spark, base, rows.where(part >= 7).unionByName(wrong), star.companies)
    refresh(spark, base, wrong, star.companies, F.lit(-1))
    return summary_table(spark, base, name)


@register("refresh_from_batches_city", ORACLE["city_salary_stats"])
def _(star, spark, d):
    return _refreshed(star, spark, "city_salary_stats")


@register("refresh_from_batches_company", ORACLE["company_summary"])
def _(star, spark, d):
    return _refreshed(star, spark, "company_summary")


# Every percentile of every city from persisted sketches (two runs, merged
# from finer cells) lies within the stated rank error; counts, mean and
# extremes are compared as they are, distinct counts within their error.
@register("sketch_city_percentiles", sql(f"""SELECT city, percentile_key, TRUE AS within FROM
  (SELECT DISTINCT c.city FROM companies c JOIN salary_records s ON c.company_id = s.company_id WHERE s.salary_amount >= 1),
  (SELECT unnest([{", ".join(f"'{k}'" for k in report.NATIONAL_PERCENTILES)}]) AS percentile_key)"""))
def _(star, spark, d):
    from salarium.plans import sketches
    base = _sketched(star, spark)
    errors = sketches.rank_errors(star, sketches.sketched(spark, base, ["city"]), "city")
    return errors.select("city", "percentile_key", (F.col("error") <= sketches.RANK_ERROR).alias("within"))


@register("sketch_city_figures", sql(f"""SELECT c.city, COUNT(*) AS record_count, {avg_d(SAL)} AS avg_salary, MIN({SAL})::DOUBLE AS min_salary,
  MAX({SAL})::DOUBLE AS max_salary, TRUE AS people_within, TRUE AS companies_within
FROM companies c JOIN salary_records s ON c.company_id = s.company_id WHERE s.salary_amount >= 1 GROUP BY c.city"""))
def _(star, spark, d):
    from salarium.operators.joins import company_fact
    from salarium.plans import sketches
    found = sketches.sketched(spark, _sketched(star, spark), ["city"])
    exact = company_fact(star).where("salary_amount >= 1").groupBy(F.col("city").alias("_city")).agg(
        F.countDistinct("employee_id").alias("people"), F.countDistinct("company_id").alias("firms"))
    both = found.join(exact, F.col("city").eqNullSafe(F.col("_city")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), F.col(b) * sketches.COUNT_ERROR)
    return both.select("city", "record_count", "avg_salary", "min_salary", "max_salary", near("employee_count", "people").alias("people_within"),
                       near("company_count", "firms").alias("companies_within"))


def _sketched(star, spark) -> str:
    """Persisted sketches of the records in two batches."""
    from dataclasses import replace

    from salarium.plans import sketches
    from salarium.sources.sinks import scratch_path
    base = scratch_path(spark, "sketches")
    for odd in (0, 1):
        sketches.add_batch(spark, base, replace(star, salary_records=star.salary_records.where(F.pmod("document_id", F.lit(2)) == odd)))
    return base


def _export(star, spark, fmt: str) -> DataFrame:
    """Export a cohort and read the file back."""
    from salarium.operators.joins import DETAIL_COLUMNS
    from salarium.sources.sinks import export_result, scratch_path
    rows = dashboard.cohort(star, COHORT).select(*DETAIL_COLUMNS)
    path = export_result(rows, scratch_path(spark, "export"), fmt)
    schema = ", ".join(f"{f.name} {'double' if isinstance(f.dataType, T.DecimalType) else f.dataType.simpleString()}"
                       for f in rows.schema.fields)
    return spark.read.schema(schema).format(fmt).load(path)


EXPORT_SQL = sql(f"SELECT {DETAIL}\n{STAR_FROM}\nWHERE {cohort_where(COHORT)}")


@register("export_result", EXPORT_SQL)
def _(star, spark, d):
    return _export(star, spark, "json")


@register("export_csv", EXPORT_SQL)
def _(star, spark, d):
    return _export(star, spark, "csv")


@register("export_parquet", EXPORT_SQL)
def _(star, spark, d):
    return _export(star, spark, "parquet")


# ---------------------------------------------------------------------------
# Generators: draws are digests that the oracle reproduces
# ---------------------------------------------------------------------------

HEADCOUNT_SQL = f"""SELECT company_id AS document_id, 'DECL_' || company_id || '_2024_01.pdf' AS filename, company_id,
  CASE WHEN company_id <= 5 THEN 15 + floor({draw("headcount", "company_id")} * 35)
       WHEN company_id <= 15 THEN 5 + floor({draw("headcount", "company_id")} * 15)
       ELSE 2 + floor({draw("headcount", "company_id")} * 8) END::INT AS employee_count, 0.0::DOUBLE AS total_salary_mass
FROM companies"""


def _pay_sql(tier: str, branches, rest) -> str:
    keys = ("company_id", "employee_id")
    cases = " ".join(f"WHEN {draw(f'{tier}-if{i}', *keys)} < {p} THEN {base} + {draw(f'{tier}-v{i}', *keys)} * {span}"
                     for i, (p, base, span) in enumerate(branches))
    return f"CASE {cases} ELSE {rest[0]} + {draw(f'{tier}-else', *keys)} * {rest[1]} END"


PAY_SQL = f"""CASE WHEN company_id IN (1, 4, 5, 6, 11, 17)
    THEN {_pay_sql("high", [(0.15, 50000, 100000), (0.40, 15000, 35000), (0.75, 8000, 12000)], (4000, 6000))}
  WHEN company_id IN (2, 7, 13, 15, 19)
    THEN {_pay_sql("medium", [(0.10, 30000, 50000), (0.30, 12000, 18000), (0.70, 6000, 8000)], (3500, 4500))}
  ELSE {_pay_sql("low", [(0.10, 20000, 30000), (0.30, 8000, 12000), (0.70, 4500, 5500)], (3000, 3000))} END"""


@register("document_headcounts", sql(HEADCOUNT_SQL))
def _(star, spark, d):
    from salarium.operators.generate import document_headcounts
    return document_headcounts(star.companies)


def _halves(i: int) -> str:
    """Undo round i of the companies' permutations."""
    half, other, size = ("l", "r", "a") if i % 2 else ("r", "l", "b")
    drawn = digest(13, "'42'", "'place'", "company_id::VARCHAR", f"'{i}'", f"{other}::VARCHAR")
    return f"SELECT * REPLACE (({half} - {drawn} % {size} + {size}) % {size} AS {half}) FROM "


# The reference's own shape: every company with every employee, each pair
# with its number in the company's order (the permutation run backwards from
# the employee), and the first numbers kept.
@register("synthetic_assignments", sql(f"""SELECT employee_id, company_id, document_id, place + 1 AS emp_num,
  CAST(CAST({PAY_SQL} AS DECIMAL(10,2)) AS DOUBLE) AS salary_amount
FROM (SELECT company_id, document_id, employee_count, x AS position, place FROM walked JOIN heads USING (company_id) WHERE place < n AND place < employee_count)
JOIN seats USING (position)""", f""", heads AS ({HEADCOUNT_SQL}), seats AS (
  SELECT employee_id, row_number() OVER (ORDER BY {digest(15, "'42'", "'order'", "employee_id::VARCHAR")}, employee_id) - 1 AS position
  FROM employees), sides AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT COUNT(*) AS n, ceil(sqrt(COUNT(*)))::BIGINT AS a FROM employees)),
back AS (SELECT company_id, n, x, l * b + r AS y FROM ({_halves(1)}({_halves(2)}({_halves(3)}({_halves(4)}(
  SELECT company_id, n, a, b, x, x // b AS l, x % b AS r FROM companies, sides, range(0, (SELECT a * b FROM sides)) t(x))))))),
walked AS (WITH RECURSIVE w AS (SELECT company_id, n, x, y AS place FROM back WHERE x < n
  UNION ALL SELECT w.company_id, w.n, w.x, back.y FROM w JOIN back ON back.company_id = w.company_id AND back.x = w.place WHERE w.place >= w.n)
  SELECT * FROM w)"""))
def _(star, spark, d):
    from salarium.operators.generate import document_headcounts, synthetic_assignments
    return synthetic_assignments(document_headcounts(star.companies), star.employees)


@register("random_order_in_company", sql(f"""SELECT company_id, employee_id, row_number() OVER (PARTITION BY company_id
  ORDER BY {digest(15, "'42'", "'order'", "company_id::VARCHAR", "employee_id::VARCHAR")}, employee_id) AS emp_num
FROM (SELECT DISTINCT company_id, employee_id FROM salary_records WHERE company_id IS NOT NULL)"""))
def _(star, spark, d):
    from salarium.operators.generate import random_order_in_company
    pairs = star.records("company_id", "employee_id").where(F.col("company_id").isNotNull())
    return random_order_in_company(pairs)


# ---------------------------------------------------------------------------
# Declaration ingest (S4) over declaration lines rendered from the tables
# ---------------------------------------------------------------------------

@register("declaration_ingest", sql("""SELECT status, row_count FROM (
  SELECT 'header' AS status, COUNT(*) AS row_count FROM documents d JOIN companies c ON d.company_id = c.company_id
  UNION ALL SELECT 'blank', COUNT(*) FROM emp_lines WHERE salary_amount IS NULL
  UNION ALL SELECT 'missing_header', COUNT(*) FROM emp_lines WHERE NOT has_header AND salary_amount IS NOT NULL
) WHERE row_count > 0
UNION ALL SELECT 'loaded', COUNT(*) FROM (SELECT DISTINCT filename, full_name, salary_amount FROM ok_lines)
UNION ALL SELECT 'duplicate', (SELECT COUNT(*) FROM ok_lines)
  - (SELECT COUNT(*) FROM (SELECT DISTINCT filename, full_name, salary_amount FROM ok_lines))""",
    """, emp_lines AS (
  SELECT d.filename, e.full_name, s.salary_amount, c.company_id IS NOT NULL AS has_header
  FROM salary_records s JOIN employees e ON s.employee_id = e.employee_id
  JOIN documents d ON s.document_id = d.document_id
  LEFT JOIN companies c ON d.company_id = c.company_id
), ok_lines AS (SELECT * FROM emp_lines WHERE has_header AND salary_amount IS NOT NULL)"""))
def _(star, spark, d):
    from salarium.sources.ingest import parse_declarations, render_declarations
    return parse_declarations(render_declarations(star)).audit


@register("ingest_records", sql("""SELECT DISTINCT d.filename, e.full_name, CAST(s.salary_amount AS DOUBLE) AS salary_amount,
  c.company_name, c.activity_description, c.city
FROM salary_records s JOIN employees e ON s.employee_id = e.employee_id
JOIN documents d ON s.document_id = d.document_id JOIN companies c ON d.company_id = c.company_id
WHERE s.salary_amount IS NOT NULL"""))
def _(star, spark, d):
    """The loaded records with their natural keys, joined through the ids."""
    from salarium.sources.ingest import parse_declarations, render_declarations
    t = parse_declarations(render_declarations(star)).star
    return (t.salary_records.join(t.employees, "employee_id").join(t.documents.select("document_id", "filename"), "document_id")
            .join(t.companies, "company_id")
            .select("filename", "full_name", "salary_amount", "company_name", "activity_description", "city"))


@register("ingest_documents", sql("""SELECT d.filename, c.company_name, COALESCE(m.people, 0)::INT AS employee_count,
  CAST(COALESCE(m.mass, 0) AS DOUBLE) AS total_salary_mass
FROM documents d JOIN companies c ON d.company_id = c.company_id
LEFT JOIN (SELECT filename, COUNT(DISTINCT full_name) AS people, SUM(salary_amount) AS mass FROM (
  SELECT DISTINCT d.filename, e.full_name, s.salary_amount FROM salary_records s JOIN employees e ON s.employee_id = e.employee_id
  JOIN documents d ON s.document_id = d.document_id WHERE s.salary_amount IS NOT NULL) GROUP BY filename) m
ON m.filename = d.filename"""))
def _(star, spark, d):
    """Every declaration, those without a single loaded line too."""
    from salarium.sources.ingest import parse_declarations, render_declarations
    t = parse_declarations(render_declarations(star)).star
    return t.documents.join(t.companies, "company_id").select("filename", "company_name", "employee_count", "total_salary_mass")


# A second batch files every seventh declaration again, from another folder,
# with all amounts one higher and, for some, without any line at all.
CORRECTED = """, filed AS (SELECT d.document_id, d.filename, d.document_id % 7 = 0 AS again, d.document_id % 21 = 0 AS emptied, c.company_name
  FROM documents d JOIN companies c ON d.company_id = c.company_id), lines AS (
  SELECT DISTINCT f.filename, e.full_name, s.salary_amount, f.again, f.emptied FROM salary_records s
  JOIN employees e ON s.employee_id = e.employee_id JOIN filed f ON f.document_id = s.document_id WHERE s.salary_amount IS NOT NULL)"""


def _filed_twice(star):
    from salarium.sources.ingest import filings, parse_declarations, render_declarations
    from salarium.sources.star import Star
    first = parse_declarations(render_declarations(star))
    again = star.documents.where(F.col("document_id") % 7 == 0).withColumn("filename", F.concat(F.lit("again/"), F.col("filename")))
    rows = star.records("employee_id", "document_id", "salary_amount").where(F.col("document_id") % 21 != 0)
    rows = rows.withColumn("salary_amount", (F.col("salary_amount") + 1).cast("decimal(15,2)"))
    second = parse_declarations(render_declarations(Star(star.companies, again, star.employees, rows)))
    both = Star(*[a.unionByName(b) if n in ("documents", "salary_records") else a.unionByName(b).distinct()
                  for (n, a), b in zip(first.star.tables().items(), second.star.tables().values())])
    filed = filings(first.star.documents, 0).unionByName(filings(second.star.documents, 1))
    return both, filed, first.audit.unionByName(second.audit)


@register("ingest_corrections", sql("""SELECT CASE WHEN again THEN 'again/' ELSE '' END || filename AS filename, full_name,
  CAST(CASE WHEN again THEN salary_amount + 1 ELSE salary_amount END AS DOUBLE) AS salary_amount FROM lines WHERE NOT emptied""", CORRECTED))
def _(star, spark, d):
    """The records that stand after a batch of corrections."""
    from salarium.sources.ingest import standing_star
    both, filed, _ = _filed_twice(star)
    t = standing_star(both, filed)
    return (t.salary_records.join(t.employees, "employee_id").join(t.documents.select("document_id", "filename"), "document_id")
            .select("filename", "full_name", "salary_amount"))


@register("ingest_corrections_audit", sql("""SELECT * FROM (SELECT 'superseded' AS status, COUNT(*) AS row_count FROM lines WHERE again
UNION ALL SELECT 'loaded', COUNT(*) FROM lines WHERE NOT emptied
UNION ALL SELECT 'header', (SELECT COUNT(*) FROM filed) + (SELECT COUNT(*) FROM filed WHERE again)) WHERE row_count > 0""", CORRECTED))
def _(star, spark, d):
    from salarium.sources.ingest import standing_audit
    both, filed, audit = _filed_twice(star)
    return standing_audit(audit, both.salary_records, filed).where("status IN ('superseded', 'loaded', 'header')")


@register("ingest_rejects", sql("""SELECT filename, 'page ' || document_id AS line, 'unparsed' AS status FROM documents WHERE document_id % 10 = 0
UNION ALL SELECT filename, 'Odd Person ; 12x' || document_id, CASE WHEN has THEN 'bad_amount' ELSE 'missing_header' END FROM kept WHERE document_id % 10 = 1
UNION ALL SELECT filename, 'Odd Person ; 7,500', CASE WHEN has THEN 'ambiguous_amount' ELSE 'missing_header' END FROM kept WHERE document_id % 10 = 2
UNION ALL SELECT filename, 'EMPLOYER:  ; ACTIVITY: A ; CITY: B', 'bad_header' FROM documents WHERE document_id % 10 = 3
UNION ALL SELECT 'lone_' || document_id, 'Odd Person ; 100.00', 'missing_header' FROM documents WHERE document_id % 10 = 4""",
    """, kept AS (SELECT d.*, c.company_id IS NOT NULL AS has FROM documents d LEFT JOIN companies c ON d.company_id = c.company_id)"""))
def _(star, spark, d):
    """Lines that a load must quarantine, one odd line for half of the
    declarations, among the good ones."""
    from salarium.sources.ingest import parse_declarations, render_declarations
    k = F.col("document_id") % 10
    odd = star.documents.where(k < 5).select(
        F.when(k == 4, F.concat(F.lit("lone_"), F.col("document_id").cast("string"))).otherwise(F.col("filename")).alias("filename"),
        F.when(k == 0, F.concat(F.lit("page "), F.col("document_id").cast("string")))
         .when(k == 1, F.concat(F.lit("Odd Person ; 12x"), F.col("document_id").cast("string")))
         .when(k == 2, F.lit("Odd Person ; 7,500")).when(k == 3, F.lit("EMPLOYER:  ; ACTIVITY: A ; CITY: B"))
         .otherwise(F.lit("Odd Person ; 100.00")).alias("line"))
    return parse_declarations(render_declarations(star).unionByName(odd)).rejects
