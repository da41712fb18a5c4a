"""Search and dashboard statistics for one cohort (the web API's queries).

The statistics are plans over one reduced frame of the cohort (company,
employee, salary, number of records), which ``stats_bundle`` shares between
its four datasets (the reference re-ran the four-way join four times).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salarium.functions.buckets import DASHBOARD_SALARY
from salarium.functions.criteria import Criteria, cohort_predicate, company_predicate, employee_predicate, salary_between
from salarium.functions.labels import truncate_label
from salarium.operators.aggregates import MEDIAN, bucket_counts, reduced, salary_stats
from salarium.operators.joins import DETAIL_COLUMNS, star_detail
from salarium.sources.star import Star

# Fixed values (reference dashboard parameters).
DASHBOARD_TOP = 20
COMPANY_MIN_EMPLOYEES = 3
CHART_TOP = 15
CHART_LABEL_CHARS = 40


def cohort(star: Star, cr: Criteria) -> DataFrame:
    """F3 + J1: star detail restricted to the criteria.  Predicates on
    company / employee columns are pushed below the joins by Catalyst."""
    return star_detail(star, cohort_predicate(cr))


def search(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    """T-1: cohort rows, highest salary first, first ``cr.limit`` rows.
    Ties are broken on every output column so the row set is stable."""
    return (cohort(star, cr).select(*DETAIL_COLUMNS)
            .orderBy(F.col("salary_amount").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in
                     ("employee_id", "company_id", "filename", "full_name", "company_name",
                      "activity_description", "city")])
            .limit(int(cr.limit)))


def _top(df: DataFrame, by: str, keys, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_first(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def cohort_people(star: Star, cr: Criteria) -> DataFrame:
    """The cohort by company, employee and salary: all that its statistics
    need.  Criteria on a dimension are tested on its own rows, which then
    filter the records as semi-joins; no column of a dimension is carried."""
    companies = star.companies.where(company_predicate(cr))
    employees = star.employees.where(employee_predicate(cr))
    lo, hi = cr.salary_range
    rows = star.records("company_id", "employee_id", "document_id", "salary_amount").where(salary_between("salary_amount", lo, hi))
    rows = (rows.join(companies.select("company_id"), "company_id", "left_semi")
            .join(employees.select("employee_id"), "employee_id", "left_semi")
            .join(star.documents.select("document_id"), "document_id", "left_semi"))
    return reduced(rows, parts=star.parts())


def city_stats(people: DataFrame, companies: DataFrame, top: int = DASHBOARD_TOP, parts: int | None = None) -> DataFrame:
    """A5: per non-null city: distinct employees, mean, median, max; top by mean."""
    s = salary_stats(people, companies.where(F.col("city").isNotNull()), ["city"], avg_name="avg_salary",
                     percentiles=MEDIAN, max_name="max_salary", parts=parts)
    return _top(s, "avg_salary", ["city"], top)


def activity_stats(people: DataFrame, companies: DataFrame, top: int = DASHBOARD_TOP, parts: int | None = None) -> DataFrame:
    """Per non-null activity: distinct employees, mean, median; top by mean."""
    s = salary_stats(people, companies.where(F.col("activity_description").isNotNull()), ["activity_description"],
                     avg_name="avg_salary", percentiles=MEDIAN, max_name=None, parts=parts)
    return _top(s, "avg_salary", ["activity_description"], top)


def salary_buckets(people: DataFrame) -> DataFrame:
    """Records per dashboard salary range (11 ranges, empty ones absent);
    a cohort has no record without a salary."""
    return bucket_counts(people, DASHBOARD_SALARY, "v", weight=F.col("f"))


def top_companies(people: DataFrame, companies: DataFrame, min_employees: int = COMPANY_MIN_EMPLOYEES,
                  top: int = DASHBOARD_TOP, parts: int | None = None) -> DataFrame:
    """Per (name, city, activity) -- not id -- with >= min_employees
    distinct employees: mean and max; top by mean."""
    keys = ["company_name", "city", "activity_description"]
    s = salary_stats(people, companies, keys, avg_name="avg_salary", max_name="max_salary",
                     min_employees=min_employees, parts=parts)
    return _top(s, "avg_salary", keys, top)


def dashboard_city_stats(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    return city_stats(cohort_people(star, cr), star.companies, parts=star.parts())


def dashboard_activity_stats(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    return activity_stats(cohort_people(star, cr), star.companies, parts=star.parts())


def dashboard_salary_buckets(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    return salary_buckets(cohort_people(star, cr))


def dashboard_top_companies(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    return top_companies(cohort_people(star, cr), star.companies, parts=star.parts())


def stats_bundle(star: Star, cr: Criteria = Criteria()) -> dict[str, DataFrame]:
    """T-2: the four dashboard datasets of one cohort, and its rows by
    company, employee and salary.  Each is a plan over that one reduced frame
    (the reference re-ran the four-way join for every dataset); taken
    together in one plan they share its shuffle."""
    people = cohort_people(star, cr)
    return {"cohort": people,
            "city_stats": city_stats(people, star.companies, parts=star.parts()),
            "activity_stats": activity_stats(people, star.companies, parts=star.parts()),
            "salary_distribution": salary_buckets(people),
            "top_companies": top_companies(people, star.companies, parts=star.parts())}


def stats_bundle_long(star: Star, cr: Criteria = Criteria()) -> DataFrame:
    """T-2 as one long DataFrame (dataset, label, measures) -- the API's four
    lists side by side.  The cohort is scanned, joined and reduced once."""
    made = stats_bundle(star, cr)
    cols = ["dataset", "label", "city", "activity_description", "employee_count", "avg_salary",
            "median_salary", "max_salary", "record_count"]

    def shape(df: DataFrame, name: str, label: str, **fill) -> DataFrame:
        out = df.withColumn("dataset", F.lit(name)).withColumn("label", F.col(label))
        for c in cols:
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast(fill.get(c, "double")))
        return out.select(*cols)

    return (shape(made["city_stats"], "city_stats", "city",
                  activity_description="string", record_count="long")
            .unionByName(shape(made["activity_stats"], "activity_stats", "activity_description",
                               city="string", record_count="long"))
            .unionByName(shape(made["salary_distribution"].withColumnRenamed("count", "record_count"),
                               "salary_distribution", "salary_range", city="string",
                               activity_description="string", employee_count="long"))
            .unionByName(shape(made["top_companies"], "top_companies", "company_name",
                               record_count="long")))


def chart_top15(star: Star, cr: Criteria = Criteria(), n: int = CHART_TOP,
                chars: int = CHART_LABEL_CHARS) -> DataFrame:
    """The dashboard charts keep the first 15 rows of the city,
    activity and company lists; long labels become 40 chars + '...'."""
    people = cohort_people(star, cr)
    cities = city_stats(people, star.companies, top=n, parts=star.parts()).select(
        F.lit("city").alias("chart"), F.col("city").alias("label"), "avg_salary", "employee_count")
    acts = activity_stats(people, star.companies, top=n, parts=star.parts()).select(
        F.lit("activity").alias("chart"),
        truncate_label("activity_description", chars, chars).alias("label"),
        "avg_salary", "employee_count")
    comps = top_companies(people, star.companies, top=n, parts=star.parts()).select(
        F.lit("company").alias("chart"), truncate_label("company_name", chars, chars).alias("label"),
        "avg_salary", "employee_count")
    return cities.unionByName(acts).unionByName(comps)
