"""The co-partitioned layout: same answers, and no shuffle of the records."""

import re

import pytest
from pyspark.sql import functions as F

from salarium.operators.joins import company_fact, employee_fact, salary_fact
from salarium.plans import report, views
from salarium.sources.layout import hot_keys, load_layout, write_layout
from salarium.sources.star import load_tpch_star
from tests.conftest import SF001


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    """The test star with one company and one employee of a third of all
    records, and records without either."""
    star = load_tpch_star(spark, SF001)
    r = star.salary_records.withColumn("record_id", F.monotonically_increasing_id())
    third = F.pmod(F.xxhash64("record_id"), F.lit(9))
    r = r.withColumn("company_id", F.when(third < 3, F.lit(1)).when(third == 4, F.lit(None)).otherwise(F.col("company_id")))
    r = r.withColumn("employee_id", F.when(third.isin(2, 5, 6), F.lit(7)).when(third == 8, F.lit(None)).otherwise(F.col("employee_id")))
    base = str(tmp_path_factory.mktemp("layout"))
    r.write.parquet(f"{base}/source")
    star.salary_records, star._records_without_company = spark.read.parquet(f"{base}/source"), None
    write_layout(star, f"{base}/star", 8)
    return star, load_layout(spark, f"{base}/star")


@pytest.mark.parametrize("fn", [company_fact, employee_fact, salary_fact, views.company_summary, report.report_city_stats, views.first_name_stats_top])
def test_same_results(stars, fn):
    assert rows(fn(stars[0])) == rows(fn(stars[1]))


def test_hot_keys_are_few(stars):
    records = stars[0].salary_records
    hot = [r.company_id for r in hot_keys(records, "company_id", 8).collect()]
    assert hot == [1]
    assert hot_keys(records, "employee_id", 8).count() == 1


@pytest.mark.parametrize("fn,key", [(company_fact, "company_id"), (employee_fact, "employee_id")])
def test_records_are_not_shuffled(spark, stars, fn, key):
    """Not even where nothing may be broadcast by size: bucket meets bucket."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fn(stars[1])._jdf.queryExecution().executedPlan().toString()
        plain = fn(stars[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # exchanges feed the broadcast of the few hot keys only
    assert not re.search(r"Exchange hashpartitioning\(%s#\d+L?, \d+\), ENSURE_REQUIREMENTS(?!.*keys=)" % key, plan.split("BroadcastExchange")[0])
    assert re.search(r"Exchange hashpartitioning\(%s#" % key, plain)
