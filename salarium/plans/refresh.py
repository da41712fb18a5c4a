"""Refresh of the summary tables from a batch of records.

What the summaries need of all records so far is kept as mergeable partial
states of each company: how many records it has of every salary (their sums,
extremes and percentiles follow) and of every employee (distinct counts).  A
batch adds its own small state as one more run; numbers of records add up, so
runs merge by a sum, and a withdrawn record counts -1.  The summaries are
derived from the runs and the companies, never from earlier records, and
their tables and the run become visible in one commit.  ``compact`` merges
the runs into one when there are many.

Companies are joined when the summaries are derived, so a corrected city or
activity moves all records of its company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.operators.aggregates import MEDIAN, stats_of_groups
from salarium.operators.joins import sizes_of_groups
from salarium.plans.views import summary_rows
from salarium.session import materialize_together
from salarium.sources.versions import commit, manifest, read_table, stage, versions

#: Runs of a state from which a refresh also compacts it.
MOST_RUNS = 20

PAY_KEYS = ("company_id", "v")
PEOPLE_KEYS = ("company_id", "employee_id")


def state_of(records: DataFrame, sign: Column | None = None) -> dict[str, DataFrame]:
    """Partial states of records (company_id, employee_id, salary_amount);
    ``sign`` is -1 for a record that is withdrawn."""
    n = F.lit(1).cast("long") if sign is None else sign.cast("long")
    rows = records.select("company_id", "employee_id", F.col("salary_amount").alias("v"), n.alias("f"))
    return {"state_pay": rows.groupBy(*PAY_KEYS).agg(F.sum("f").alias("f")), "state_people": rows.groupBy(*PEOPLE_KEYS).agg(F.sum("f").alias("f"))}


def merged(runs: DataFrame, keys) -> DataFrame:
    """Runs of one state as one: groups whose records all went are gone, and
    more withdrawn than there were is an error."""
    total = runs.groupBy(*keys).agg(F.sum("f").alias("f")).where("f != 0")
    return total.withColumn("f", F.expr("if(f > 0, f, cast(raise_error(concat('withdrawn without a record: ', f)) AS bigint))"))


def summaries(pay: DataFrame, people: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """The summary tables from merged states."""
    def by(key: str, max_name: str | None) -> DataFrame:
        return stats_of_groups(pay, people, companies, [key], company_count=True, avg_name="average_salary", percentiles=MEDIAN, max_name=max_name)

    return {"company_summary": summary_rows(companies, sizes_of_groups(pay, people)),
            "city_salary_stats": by("city", "max_salary"), "activity_salary_stats": by("activity_description", None)}


def refresh(spark: SparkSession, base: str, batch: DataFrame, companies: DataFrame, sign: Column | None = None) -> int:
    """Take one batch of records into the summary tables under ``base``; the
    new version.  Reads the batch, the state and the companies only."""
    after = (versions(spark, base) or [0])[-1]
    held = manifest(spark, base)
    keys = {"state_pay": PAY_KEYS, "state_people": PEOPLE_KEYS}
    add, put, states = {}, {}, {}
    for name, run in state_of(batch, sign).items():
        folder = stage(run, base, name)
        folders = [*held.get(name, []), folder]
        states[name] = merged(spark.read.parquet(*[f"{base}/{f}" for f in folders]), keys[name])
        if len(folders) > MOST_RUNS:
            put[name] = stage(states[name], base, name, ["company_id"])
            states[name] = spark.read.parquet(f"{base}/{put[name]}")
        else:
            add[name] = folder
    for name, df in materialize_together(summaries(states["state_pay"], states["state_people"], companies)).items():
        put[name] = stage(df, base, name)
    return commit(spark, base, put, add, after)


def summary_table(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    return read_table(spark, base, name, version)
