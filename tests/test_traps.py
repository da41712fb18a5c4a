"""Hand-made fixtures for the semantic traps."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from salarium.functions.buckets import DASHBOARD_SALARY, REPORT_SALARY
from salarium.functions.criteria import Criteria, contains_ci, like_pattern
from salarium.operators.joins import company_fact, star_detail
from salarium.plans import dashboard, report, views
from salarium.sources.star import star_from_rows

COMPANIES = [(1, "Alpha", "Tech", "Rabat"), (2, "Beta", "Retail", None), (3, "Gamma", None, "Fes"),
             (4, "Lonely", "Tech", "Rabat"), (5, "Twin", "Tech", "Rabat"), (6, "Twin", "Tech", "Rabat"),
             (7, "50%_off\\shop", "Retail", "Casa"), (8, "Ghost", "Tech", "Casa")]
EMPLOYEES = [(1, "Amal Alaoui"), (2, "Bilal Alaoui"), (3, "Chama "), (4, "Driss"), (5, "A  B")]
DOCUMENTS = [(i, f"d{i}", i, None, None) for i in (1, 2, 3, 5, 6, 7, 8)]
RECORDS = [
    (1, 1, 1, 1, D("5000.00")), (2, 2, 1, 1, D("4999.99")), (3, None, 1, 1, D("7000.00")),
    (4, 3, 2, None, D("12000.00")), (5, 4, 2, 2, None), (6, 5, 3, 3, D("100000.00")),
    (7, 1, 5, 5, D("3000.00")), (8, 2, 6, 6, D("3001.00")), (9, 3, 6, 6, D("2999.99")),
    (10, 4, 7, 7, D("1000000.00")), (11, 1, None, 1, D("999.00")), (12, None, 8, 8, D("1500.00")),
]


@pytest.fixture(scope="module")
def star(spark):
    return star_from_rows(spark, COMPANIES, DOCUMENTS, EMPLOYEES, RECORDS)


def test_t1_join_shape_row_loss(star):
    j1 = {r.salary_amount for r in star_detail(star).collect()}
    assert D("7000.00") not in j1 and D("12000.00") not in j1 and D("999.00") not in j1
    j2 = {r.salary_amount for r in company_fact(star).collect()}
    assert D("7000.00") in j2 and D("12000.00") in j2 and D("999.00") not in j2


def test_t2_null_groups(star):
    v3 = {r.city for r in views.city_salary_stats(star).collect()}
    assert None in v3
    a9 = {r.city for r in report.report_city_stats(star).collect()}
    assert None not in a9
    v4 = {r.activity_description for r in views.activity_salary_stats(star).collect()}
    assert None in v4


def test_t5_nulls_first_desc(star):
    first = views.top_earners(star).first()
    assert first.salary_amount is None


def test_t6_null_falls_to_else():
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    r = s.createDataFrame([(None,)], "x decimal(15,2)").select(DASHBOARD_SALARY.label("x").alias("l")).first()
    assert r.l == "1M+"


def test_t7_empty_buckets_absent_and_share_rows_present(star):
    b = {r.salary_range: r["count"] for r in report.report_salary_buckets(star).collect()}
    assert "8K-10K" not in b and "15K-20K" not in b and "500K-1M" not in b
    assert b["10K-15K"] == 1 and b["1M+"] == 1 and sum(b.values()) == 11
    shares = views.top_income_shares(star).collect()
    assert [r.income_group for r in shares] == ["Top 0.1%", "Top 1%", "Top 10%"]


def test_t8_like_wildcards(star, spark):
    assert like_pattern("50%") == "%50%%"
    assert like_pattern("f\\s") == "%fs%"
    assert like_pattern("a\\%b") == "%a\\%b%"
    names = {r.company_name for r in star.companies.where(contains_ci("company_name", "0%_o")).collect()}
    assert names == {"50%_off\\shop"}
    lit = star.companies.where(contains_ci("company_name", "%", literal=True)).count()
    assert lit == 1
    star.companies.where(contains_ci("company_name", "f\\s")).count()   # no Spark error


def test_t10_single_record_city(star):
    fes = [r for r in report.report_city_stats(star).collect() if r.city == "Fes"][0]
    assert fes.stddev_salary is None
    cv = {r.city: r.cv for r in report.page_city_cv(star).collect()}
    assert cv["Fes"] is None


def test_t11_name_tokens(spark):
    df = spark.createDataFrame([("Chama ",), ("A  B",), ("Driss",), ("x y z",)], "full_name string")
    got = [r.t for r in df.select(views.name_token().alias("t")).collect()]
    assert got == ["", "B", "Driss", "z"]


@pytest.mark.parametrize("v,dash,rep", [("4999.99", "< 5K", "3K-5K"), ("5000.00", "5K-10K", "5K-8K"),
                                        ("2999.99", "< 5K", "< 3K"), ("3000.00", "< 5K", "3K-5K"),
                                        ("999999.99", "500K-1M", "500K-1M"), ("1000000.00", "1M+", "1M+")])
def test_t13_bucket_edges(spark, v, dash, rep):
    r = spark.createDataFrame([(v,)], "x string").select(F.col("x").cast("decimal(15,2)").alias("x"))\
             .select(DASHBOARD_SALARY.label("x").alias("d"), REPORT_SALARY.label("x").alias("r")).first()
    assert (r.d, r.r) == (dash, rep)


def test_t14_company_identity(star):
    twins = [r for r in dashboard.top_companies(dashboard.cohort_people(star, Criteria()), star.companies).collect()
             if r.company_name == "Twin"]
    assert len(twins) == 1 and twins[0].employee_count == 3
    a1 = [r for r in views.company_summary(star).collect() if r.company_name == "Twin"]
    assert len(a1) == 2


def test_lonely_company_and_size_quirk(star):
    lonely = [r for r in views.company_summary(star).collect() if r.company_id == 4][0]
    assert (lonely.employee_count, lonely.average_salary, lonely.max_salary, lonely.min_salary) == (0, 0.0, 0.0, 0.0)
    sizes = {r.size_range: r.company_count for r in report.company_size_distribution(star).collect()}
    # company 8 has one record with a NULL employee: COUNT(DISTINCT) = 0 falls to ELSE
    assert sizes.get("1000+ employees") == 1


def test_mean_median_and_rounding(star):
    r = views.mean_median_ratio(star).first()
    assert r.record_count == len(RECORDS)
    toks = {t.first_name: t for t in views._token_stats(star, 1).collect()}
    assert "" not in toks and "Alaoui" in toks
    assert toks["Alaoui"].avg_salary == round((5000 + 4999.99 + 3000 + 3001 + 999) / 5, 2)
