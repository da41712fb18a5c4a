"""Table jobs from the reference's seed / maintenance script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.functions.numeric import PERCENTILE_DIGITS, rnd
from salarium.operators.aggregates import MEDIAN
from salarium.operators.joins import DETAIL_COLUMNS, star_detail
from salarium.operators.ranks import quantile_exprs, quantile_value, rank_frame
from salarium.plans import views
from salarium.session import materialize_together, shuffles_dropped
from salarium.sources.sinks import drop_scratch, reload_tables, replace_table, scratch_path, write_table
from salarium.sources.star import SALARY, Star, load_star
from salarium.sources.versions import commit, read_table, stage, versions

# Fixed values (labels of the reference's verification queries).
ROW_COUNT_LABELS = [("Companies:", "companies"), ("Employees:", "employees"),
                    ("Documents:", "documents"), ("Salary Records:", "salary_records")]
METRIC_LABELS = ("Avg Salary", "Median Salary", "Max Salary")


def document_mass_backfill(star: Star) -> DataFrame:
    """total_salary_mass = COALESCE(SUM(salary), 0) per document.
    The correlated subquery becomes a pre-aggregation of records by
    document (partial aggregation before the shuffle) and a LEFT join."""
    mass = (star.records("document_id", "salary_amount").groupBy("document_id")
            .agg(F.sum("salary_amount").alias("_mass")))
    d = star.documents.drop("total_salary_mass")
    return (d.join(mass, "document_id", "left")
             .withColumn("total_salary_mass", F.coalesce(F.col("_mass"), F.lit(0)).cast(SALARY))
             .drop("_mass"))


def backfill_documents(spark: SparkSession, base: str) -> int:
    """S7 as a job on the native layout: the documents with their masses
    filled in, as the next version; the other tables stay."""
    return replace_table(spark, base, "documents", document_mass_backfill(load_star(spark, base)))


def table_row_counts(star: Star) -> DataFrame:
    """(table, row count) for the four tables."""
    tabs = star.tables()
    parts = [tabs[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias("table_name"),
                                                                       "row_count")
             for label, t in ROW_COUNT_LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def metric_value_stats(star: Star) -> DataFrame:
    """(metric, value) long form: rounded mean, median, max, all from
    one pass over the rank frame."""
    rf = rank_frame(star.records("salary_amount"), "salary_amount")
    one = rf.df.agg(*quantile_exprs(MEDIAN), F.max("n").alias("n"), F.max("total").alias("total"), F.max("vmax").alias("vmax"))
    one = one.select(F.round(F.try_divide(F.col("total").cast("decimal(25,2)"), F.col("n")), 2).cast("double").alias("a"),
                     rnd(quantile_value("median_salary"), PERCENTILE_DIGITS).alias("p"), F.col("vmax").cast("double").alias("m"))
    a, p, m = METRIC_LABELS
    return one.selectExpr(f"stack(3, '{a}', a, '{p}', p, '{m}', m) AS (metric, value)")


def reload_and_count(spark: SparkSession, star: Star) -> DataFrame:
    """S10 round trip: write the four tables to a fresh folder under the
    shared checkpoint directory, read them back with the declared schemas,
    count the rows and sum what they hold."""
    base = scratch_path(spark, "star")
    reload_tables(star, base)
    sums = {"companies": "company_id", "employees": "employee_id", "documents": "document_id", "salary_records": "salary_amount"}
    tabs, out = load_star(spark, base).tables(), None
    for label, t in ROW_COUNT_LABELS:
        part = tabs[t].agg(F.count(F.lit(1)).alias("row_count"), F.sum(sums[t]).cast("double").alias("content_sum"))
        part = part.select(F.lit(label).alias("table_name"), "row_count", "content_sum")
        out = part if out is None else out.unionAll(part)
    return out


SUMMARY_TABLES = ("company_summary", "top_earners", "city_salary_stats", "activity_salary_stats")


def refresh_summary_tables(spark: SparkSession, star: Star, base: str | None = None) -> DataFrame:
    """Persist the four views as one new version of the tables and
    report the rows written per table and a sum over each.  (From a batch of
    records instead of all of them: ``plans/refresh.py``.)

    The shuffles of the star's joins, of the sort and of the statistics never
    lie on disk together: each goes before the next begins, and the joined
    rows wait for the sort in columns, by far smaller than their shuffles."""
    base = base or scratch_path(spark, "summary")
    after = (versions(spark, base) or [0])[-1]
    put = {}
    with shuffles_dropped(spark):
        detail = scratch_path(spark, "detail")
        write_table(star_detail(star).select(*DETAIL_COLUMNS), detail)
        put["top_earners"] = stage(views.top_earners(star, spark.read.parquet(detail)), base, "top_earners")
        drop_scratch(spark, detail)
        people = views.all_people(star)
        made = materialize_together({name: getattr(views, name)(star, people) for name in SUMMARY_TABLES if name != "top_earners"})
        put.update({name: stage(df, base, name) for name, df in made.items()})
        commit(spark, base, put, after=after)
    out = None
    for name in SUMMARY_TABLES:
        total = "salary_amount" if name == "top_earners" else "employee_count"
        part = read_table(spark, base, name).agg(F.count(F.lit(1)).alias("row_count"), F.sum(total).cast("double").alias("content_sum"))\
                    .select(F.lit(name).alias("table_name"), "row_count", "content_sum")
        out = part if out is None else out.unionAll(part)
    return out
