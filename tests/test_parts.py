"""Grouped statistics in tasks of a bounded number of records."""

import dataclasses
import os
import random
import re
import statistics
import time
from decimal import Decimal

import pytest

from salarium.operators import aggregates
from salarium.plans import jobs, report, views
from salarium.session import DROP_SHUFFLES, together
from salarium.sources import star as stars
from salarium.sources.versions import read_table


def rows_of(seed=5, n=3000):
    """Records of 40 companies in three cities and none, a third of them of
    one value, some of them without an employee, a value or a company."""
    rng = random.Random(seed)
    companies = [(c, f"C{c % 35}", None if c % 7 == 0 else f"A{c % 3}", None if c % 10 == 0 else f"city{c % 3}") for c in range(1, 41)]
    records = []
    for i in range(n):
        value = Decimal("3000.00") if i % 3 == 0 else None if i % 50 == 1 else Decimal(rng.randrange(50, 9_000_000)) / 100
        company = None if i % 97 == 0 else 1 if i % 4 == 0 else rng.randrange(1, 45)
        records.append((i, None if i % 11 == 0 else rng.randrange(400), company, 1, value))
    return companies, records


def figures(values, people):
    vs = sorted(float(v) for v in values)

    def at(p):
        k = p * (len(vs) - 1)
        return vs[int(k)] + (vs[min(int(k) + 1, len(vs) - 1)] - vs[int(k)]) * (k - int(k))
    return [len(people - {None}), sum(vs) / len(vs), at(.5), at(.25), at(.75), statistics.stdev(vs) if len(vs) > 1 else None, max(vs), min(vs)]


NAMES = ["employee_count", "avg_salary", "median_salary", "p25_salary", "p75_salary", "stddev_salary", "max_salary", "min_salary"]


def same(row, want):
    return all(row[c] is None and w is None or abs(row[c] - w) < 1e-4 for c, w in zip(NAMES, want, strict=True))


def small_parts(spark, monkeypatch, parts=37):
    companies, records = rows_of()
    monkeypatch.setattr(stars, "TASK_RECORDS", -(-len(records) // parts), raising=False)
    star = stars.star_from_rows(spark, companies, [(1, "d", 1, None, None)], [(e, f"n{e}") for e in range(400)], records)
    return star, companies, records


def test_wide_steps_are_dealt_by_the_number_of_records(spark, monkeypatch):
    """Each wide step of the statistics has a task for so many records and no
    more, whatever size Spark would merge its shuffles to."""
    star, _, records = small_parts(spark, monkeypatch)
    parts = -(-len(records) // stars.TASK_RECORDS)
    assert star.parts() == max(parts, spark.sparkContext.defaultParallelism)
    for df in (report.report_company_stats(star), report.page_city_cv(star), views.city_salary_stats(star)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        dealt = set(re.findall(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan))
        keys = {re.sub(r"#\d+L?", "", k) for k, n in dealt if int(n) == star.parts()}
        assert {"company_id, employee_id, salary_amount", "g, _cell", "g, _who", "g, _bucket"} <= keys


def test_statistics_of_dealt_groups_against_brute_force(spark, monkeypatch):
    star, companies, records = small_parts(spark, monkeypatch)
    where = {c[0]: c for c in companies}
    by_city, by_name = {}, {}
    for _, employee, company, _, value in records:
        if company in where and value is not None and value >= 1:
            _, name, activity, city = where[company]
            for groups, key in ((by_city, city), (by_name, (name, city, activity))):
                vs, es, cs = groups.setdefault(key, ([], set(), set()))
                vs.append(value), es.add(employee), cs.add(company)
    got = {r.city: r for r in report.report_city_stats(star).collect()}
    assert set(got) == set(by_city) - {None}
    for city, r in got.items():
        assert same(r, figures(*by_city[city][:2])) and r.company_count == len(by_city[city][2]), city
    got = {(r.company_name, r.city, r.activity_description): r for r in report.report_company_stats(star).collect()}
    assert set(got) == {k for k, (_, es, _) in by_name.items() if len(es - {None}) >= 10}
    for k, r in got.items():
        assert same(r, figures(*by_name[k][:2])), k
    heads = {r.city: (r.employee_count, r.company_count) for r in views.city_salary_stats(star).collect()}
    everyone = {}
    for _, employee, company, _, _ in records:
        if company in where:
            es, cs = everyone.setdefault(where[company][3], (set(), set()))
            es.add(employee), cs.add(company)
    assert heads == {c: (len(es - {None}), len(cs)) for c, (es, cs) in everyone.items()}


SHARED = ("company_summary", "city_salary_stats", "activity_salary_stats")


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("few", [10_000, 2])
def test_statistics_of_one_frame_are_those_of_each(spark, monkeypatch, few):
    """Also of companies, employees or values that are null, and of companies
    that come twice; with more groups than may be sent to all tasks, too."""
    monkeypatch.setattr(aggregates, "FEW_GROUPS", few)
    star, companies, _ = small_parts(spark, monkeypatch)
    again = spark.createDataFrame([*companies, *companies[3:6], (99, "none", "A9", "empty")], stars.COMPANIES)
    star = dataclasses.replace(star, companies=again)
    people = views.all_people(star)
    for name in SHARED:
        assert plain(getattr(views, name)(star, people)) == plain(getattr(views, name)(star)), name


def test_statistics_of_one_frame_move_records_by_company_once(spark, monkeypatch):
    """Records go by company once for all three, and then only their
    employees, once for each statistic: no salaries, no weights."""
    star, _, _ = small_parts(spark, monkeypatch)
    people = views.all_people(star)
    df = together({name: getattr(views, name)(star, people) for name in SHARED})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = "\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line)
    dealt = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^()]*), \d+\), REPARTITION_BY_NUM", own)]
    # the members of the two groupings meet the records by the same keys
    assert sorted(dealt) == ["company_id, _lot"] * 3 + ["g, employee_id"] * 2


def test_a_refresh_leaves_no_shuffles_and_no_scratch(spark, monkeypatch, tmp_path):
    star, _, _ = small_parts(spark, monkeypatch)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    scratch = []
    monkeypatch.setattr(jobs, "scratch_path", lambda spark, name: scratch.append(f"{tmp_path}/{name}") or scratch[-1])
    setting, star_of_before = spark.conf.get(DROP_SHUFFLES, None), star.parts()
    before = shuffles()
    jobs.refresh_summary_tables(spark, star, f"{tmp_path}/out")
    end = time.time() + 20
    while (left := [f for f in shuffles() - before if f.endswith(".data")]) and time.time() < end:
        time.sleep(0.2)
    assert not left and star_of_before == star.parts()
    assert scratch and not any(map(os.path.exists, scratch))
    assert spark.conf.get(DROP_SHUFFLES, None) == setting
    for name in (*SHARED, "top_earners"):
        assert plain(read_table(spark, f"{tmp_path}/out", name)) == plain(getattr(views, name)(star)), name
