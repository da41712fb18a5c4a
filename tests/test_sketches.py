"""Persisted sketches against exact figures, and merging over any cells."""

from dataclasses import replace

from pyspark.sql import functions as F

from salarium.operators.joins import company_fact
from salarium.plans import report, sketches
from salarium.sources.star import load_tpch_star
from salarium.sources.versions import manifest
from tests.conftest import SF01


def test_runs_merge_to_the_whole(spark, tmp_path):
    star, base = load_tpch_star(spark, SF01), str(tmp_path / "s")
    for k in range(3):
        sketches.add_batch(spark, base, replace(star, salary_records=star.salary_records.where(F.pmod("document_id", F.lit(3)) == k)))
    assert len(manifest(spark, base)[sketches.TABLE]) == 3
    one = sketches.sketched(spark, base).first()
    exact = report.national_percentiles(star).first()
    assert one.record_count == exact.record_count and one.min_salary == exact.min and one.max_salary == exact.max
    assert abs(one.avg_salary - exact.avg) < 1e-9 * exact.avg
    values = sorted(float(r.salary_amount) for r in company_fact(star).where("salary_amount >= 1").collect())
    for name, p in report.NATIONAL_PERCENTILES.items():
        below, upto = sum(v < one[name] for v in values), sum(v <= one[name] for v in values)
        assert below / len(values) - sketches.RANK_ERROR <= p <= upto / len(values) + sketches.RANK_ERROR, name
    people = company_fact(star).select("employee_id").distinct().count()
    assert abs(one.employee_count - people) <= sketches.COUNT_ERROR * people
    errors = sketches.rank_errors(star, sketches.sketched(spark, base, ["city"]), "city")
    assert errors.agg(F.max("error")).first()[0] <= sketches.RANK_ERROR


def test_cells_are_chosen_before_merging(spark, tmp_path):
    star, base = load_tpch_star(spark, SF01), str(tmp_path / "s")
    sketches.add_batch(spark, base, star)
    some = F.col("activity_description").isin("MACHINERY", "BUILDING")
    got = {r.city: r.record_count for r in sketches.sketched(spark, base, ["city"], some).collect()}
    want = {r.city: r["count"] for r in company_fact(star).where(some & (F.col("salary_amount") >= 1)).groupBy("city").count().collect()}
    assert got == want
