"""Table versions, and summary tables refreshed from batches of records."""

import pytest
from pyspark.sql import functions as F

from salarium.plans import jobs, refresh, report, views
from salarium.session import together
from salarium.sources import versions as V
from salarium.sources.sinks import reload_tables, replace_table
from salarium.sources.star import load_star, load_tpch_star
from tests.conftest import SF001


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or sorted(df.columns))).collect()), key=repr)


def test_commits_are_seen_whole(spark, tmp_path):
    base = str(tmp_path / "t")
    assert V.versions(spark, base) == [] and V.manifest(spark, base) == {}
    a = V.stage(spark.range(3), base, "a")
    with pytest.raises(ValueError):
        V.read_table(spark, base, "a")  # staged, not committed
    assert V.commit(spark, base, {"a": a, "b": V.stage(spark.range(5), base, "b")}) == 1
    assert V.commit(spark, base, add={"a": V.stage(spark.range(3, 4), base, "a")}) == 2
    assert V.read_table(spark, base, "a").count() == 4 and V.read_table(spark, base, "b").count() == 5
    assert V.read_table(spark, base, "a", 1).count() == 3
    assert V.commit(spark, base, {"a": V.stage(spark.range(1), base, "a")}, after=2) == 3
    with pytest.raises(RuntimeError):
        V.commit(spark, base, {"a": a}, after=2)  # another commit came first
    assert V.read_table(spark, base, "a").count() == 1
    V.stage(spark.range(9), base, "a")  # a job that died before its commit
    assert V.vacuum(spark, base, keep=1) == 3
    assert V.versions(spark, base) == [3] and V.read_table(spark, base, "b").count() == 5


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    V.commit(spark, base, {"a": V.stage(spark.range(1), base, "a")})
    late = V.stage(spark.range(7), base, "a")
    V.commit(spark, base, {"a": V.stage(spark.range(2), base, "a")})
    monkeypatch.setattr(V, "versions", lambda *_: [1])  # as the late writer has seen it
    with pytest.raises(Exception, match="(?i)exist"):
        V.commit(spark, base, {"a": late})
    monkeypatch.undo()
    assert V.read_table(spark, base, "a").count() == 2


def test_a_failing_job_leaves_the_old_version(spark, tmp_path):
    star, base = load_tpch_star(spark, SF001), str(tmp_path / "star")
    reload_tables(star, base)
    before = load_star(spark, base).documents.count()
    bad = star.documents.withColumn("filename", F.expr("if(document_id > 5, raise_error('lost'), filename)"))
    with pytest.raises(Exception, match="lost"):
        replace_table(spark, base, "documents", bad)
    star.documents = bad
    with pytest.raises(Exception, match="lost"):
        reload_tables(star, base)
    again = load_star(spark, base)
    assert V.versions(spark, base) == [1] and again.documents.count() == before
    assert jobs.backfill_documents(spark, base) == 2  # reads the table that it replaces
    mass = {r.document_id: r.total_salary_mass for r in load_star(spark, base).documents.collect()}
    want = {r.document_id: r.total_salary_mass for r in jobs.document_mass_backfill(again).collect()}
    assert mass == want and load_star(spark, base).salary_records.count() == again.salary_records.count()


def test_refresh_equals_recompute_and_reads_the_batch_only(spark, tmp_path):
    star, base = load_tpch_star(spark, SF001), str(tmp_path / "sum")
    cols = ("company_id", "employee_id", "document_id", "salary_amount")
    part = F.pmod("document_id", F.lit(4))
    for k in range(3):
        batch = star.records(*cols).where(part == k)
        if k == 2:  # a batch with records without company, employee or salary
            batch = batch.unionByName(spark.createDataFrame([(None, 1, 1, None), (1, None, 2, None), (2, None, 3, None)], batch.schema))
        batch.write.parquet(str(tmp_path / f"batch{k}"))
        refresh.refresh(spark, base, spark.read.parquet(str(tmp_path / f"batch{k}")), star.companies)
    everything = spark.read.parquet(*[str(tmp_path / f"batch{k}") for k in range(3)])
    star.salary_records, star._records_without_company = everything.withColumn("record_id", F.lit(None).cast("long")), None
    for name in ("company_summary", "city_salary_stats", "activity_salary_stats"):
        assert rows(refresh.summary_table(spark, base, name)) == rows(getattr(views, name)(star)), name
    # a withdrawn batch leaves what was before it
    refresh.refresh(spark, base, spark.read.parquet(str(tmp_path / "batch1")), star.companies, F.lit(-1))
    star.salary_records = star.salary_records.where((F.pmod("document_id", F.lit(4)) != 1) | F.col("salary_amount").isNull())
    assert rows(refresh.summary_table(spark, base, "city_salary_stats")) == rows(views.city_salary_stats(star))
    assert rows(refresh.summary_table(spark, base, "company_summary", 3)) != rows(refresh.summary_table(spark, base, "company_summary"))
    with pytest.raises(Exception, match="withdrawn"):
        refresh.refresh(spark, base, spark.read.parquet(str(tmp_path / "batch1")), star.companies, F.lit(-1))
    # the plan of the summaries knows the runs and the companies, no batch
    held = V.manifest(spark, base)
    runs = {n: refresh.merged(V.read_table(spark, base, n), k) for n, k in (("state_pay", refresh.PAY_KEYS), ("state_people", refresh.PEOPLE_KEYS))}
    for df in refresh.summaries(runs["state_pay"], runs["state_people"], star.companies).values():
        files = {f.split("://")[-1] for f in df.inputFiles()}
        assert files and all("/state_" in f or f.endswith(("customer.parquet", "nation.parquet")) for f in files)
    assert len(held["state_pay"]) == 4


def test_summaries_of_a_refresh_share_their_shuffles(spark, tmp_path, monkeypatch):
    star, base, seen = load_tpch_star(spark, SF001), str(tmp_path / "sum"), {}

    def stage(df, base, name, *more):
        seen[name] = df._jdf.queryExecution().toString()
        return V.stage(df, base, name, *more)

    monkeypatch.setattr(refresh, "stage", stage)
    refresh.refresh(spark, base, star.records("company_id", "employee_id", "document_id", "salary_amount"), star.companies)
    for name in ("company_summary", "city_salary_stats", "activity_salary_stats"):
        assert "Aggregate" not in seen[name] and "/state_" not in seen[name], name  # made already, in one job
        assert rows(refresh.summary_table(spark, base, name)) == rows(getattr(views, name)(star)), name


def test_views_of_one_reduced_frame_scan_the_records_once(spark):
    star = load_tpch_star(spark, SF001)
    people = views.all_people(star)
    names = ("company_summary", "city_salary_stats", "activity_salary_stats")
    one = together({name: getattr(views, name)(star, people) for name in names})
    one.collect()
    final = one._jdf.queryExecution().toString().split("== Physical Plan ==")[-1].split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1
    for name in names:
        assert rows(one.where(F.col("_table") == name).select(f"{name}.*")) == rows(getattr(views, name)(star)), name


def test_companies_join_last_where_every_record_stays(spark):
    """Names of companies are the widest columns: no later join moves them again."""
    plan = views.top_earners(load_tpch_star(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "company_id" in joins[0] and "employee_id" in joins[1]


def test_runs_are_compacted(spark, tmp_path, monkeypatch):
    star, base = load_tpch_star(spark, SF001), str(tmp_path / "sum")
    monkeypatch.setattr(refresh, "MOST_RUNS", 2)
    rec = star.records("company_id", "employee_id", "document_id", "salary_amount")
    for k in range(4):
        refresh.refresh(spark, base, rec.where(F.pmod("document_id", F.lit(4)) == k), star.companies)
    assert len(V.manifest(spark, base)["state_pay"]) <= 2
    assert rows(refresh.summary_table(spark, base, "company_summary")) == rows(views.company_summary(star))


def test_native_layout_reads_the_last_version(spark, tmp_path):
    star, base = load_tpch_star(spark, SF001), str(tmp_path / "star")
    reload_tables(star, base)
    assert rows(report.report_city_stats(load_star(spark, base))) == rows(report.report_city_stats(star))
