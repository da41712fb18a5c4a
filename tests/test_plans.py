"""Plan assertions: no Python in any registered plan, no full-table window
on one partition, pushdown and pruning into the Parquet scan."""

import os
import re
import subprocess
import sys
import time

import pytest

import __spark_entry__ as E
from salarium.session import cluster_conf
from tests.conftest import SF001

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_no_python_and_no_single_partition_row_window(spark, name):
    p = plan_of(E.queries()[name](spark, SF001))
    assert not any(n in p for n in PY_NODES), name
    for line in p.splitlines():
        if "Window [" in line and "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            # A window without a partition spec is allowed only over the
            # bounded per-bucket totals of the rank core (_bf/_bs/_bn).
            first = spec.split(",", 1)[0]
            # partition expressions come first and carry no sort direction
            partitioned = not first.startswith("specifiedwindowframe") and " ASC" not in first \
                and " DESC" not in first
            assert partitioned or "_bf" in line or "_bn" in line or "_bs" in line, (name, line)


def test_pushdown_and_pruning(spark):
    p = plan_of(E.queries()["report_salary_buckets"](spark, SF001))
    assert "PushedFilters: [IsNotNull(l_extendedprice)" in p or "IsNotNull(l_extendedprice)" in p
    scan = [line for line in p.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert scan and all("l_orderkey" not in s and "l_shipdate" not in s for s in scan)


def test_rank_window_is_hash_partitioned(spark):
    p = plan_of(E.queries()["national_percentiles"](spark, SF001))
    assert "hashpartitioning(_bucket" in p


@pytest.mark.parametrize("name", ["report_city_stats", "report_company_stats", "national_percentiles",
                                  "dashboard_city_stats", "income_deciles", "city_salary_stats", "mean_median_ratio",
                                  "metric_value_stats", "top_income_shares", "lorenz_curve", "report_summary", "page_lorenz",
                                  "hoover", "stats_bundle", "chart_top15"])
def test_fact_is_scanned_once(spark, name):
    """Grouped statistics and the rank core read the fact once: every other
    use of the histogram shuffle is a ReusedExchange.  A predicate pushed
    below the shared aggregate on one branch would show up here as a second
    scan."""
    q = E.queries()[name](spark, SF001)
    q.collect()
    final = plan_of(q).split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1, name
    assert "ReusedExchange" in final, name


@pytest.mark.parametrize("name", ["company_summary", "company_size_distribution", "page_company_sizes", "having_min_count",
                                  "size_vs_salary_corr"])
def test_distinct_employees_are_shuffled_on_both_keys(spark, name):
    """A company with a third of all records must not be counted in one
    task: records are reduced by (company, employee) first."""
    p = plan_of(E.queries()[name](spark, SF001))
    assert re.search(r"hashpartitioning\(company_id#\d+L?, employee_id#\d+", p)
    assert "count(distinct" not in p


def test_hoover_needs_no_running_sums(spark):
    """Only the totals of the rank frame: no sort of values, no shuffle by bucket and value."""
    p = plan_of(E.queries()["hoover"](spark, SF001))
    assert not re.search(r"Sort \[_bucket#\d+ ASC NULLS FIRST, v#", p) and "_off_f" not in p


@pytest.mark.parametrize("name", ["atkinson", "atkinson_log"])
def test_single_aggregate_needs_no_rank_frame(spark, name):
    p = plan_of(E.queries()[name](spark, SF001))
    assert p.count("lineitem.parquet") == 1 and "Window" not in p and "_bucket" not in p


def test_cluster_conf_follows_the_shuffle():
    small, large = cluster_conf(1 << 30), cluster_conf(10 << 40)
    assert small["spark.sql.shuffle.partitions"] == "2000"
    assert large["spark.sql.shuffle.partitions"] == str(10 * 4096)


def test_scratch_folders_go_with_the_driver(tmp_path):
    """Written in a session of its own, gone once its driver has ended."""
    code = ("from pyspark.sql import SparkSession\n"
            "from salarium.sources.sinks import scratch_path\n"
            f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
            "p = scratch_path(s, 'x')\n"
            "s.range(3).write.mode('overwrite').parquet(p)\n"
            "assert s.read.parquet(p).count() == 3\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(E.__file__), timeout=120)
    # Spark's JVM removes them in its exit hook, which may end after Python
    until = time.time() + 30
    while list(tmp_path.glob("salarium-*")) and time.time() < until:
        time.sleep(0.2)
    assert not list(tmp_path.glob("salarium-*"))


@pytest.mark.parametrize("name", ["city_salary_stats", "activity_salary_stats", "report_city_stats", "report_activity_stats",
                                  "report_company_stats", "dashboard_city_stats", "dashboard_activity_stats"])
def test_rows_are_reduced_before_dimensions_are_joined(spark, name):
    """No Expand anywhere, and the columns of a dimension meet aggregates:
    names never travel with single records."""
    p = plan_of(E.queries()[name](spark, SF001))
    assert "Expand" not in p
    joins = [i for i, line in enumerate(p.splitlines()) if "Join" in line]
    assert joins
    for column in ("c_mktsegment", "n_name"):
        for line in p.splitlines():
            if "Exchange" in line and "salary_amount" in line:
                assert column not in line
    assert re.search(r"hashpartitioning\(company_id#\d+L?, employee_id#\d+L?, salary_amount#\d+", p)
