import os

import pytest
from pyspark.sql import functions as F

from salarium.streaming import declaration_stream, load_audit, load_ingested


def write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_incremental_ingest(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    os.makedirs(src)
    write(src / "a.txt", ["EMPLOYER: Acme ; ACTIVITY: Tech ; CITY: Rabat", "Amal Alaoui ; 1 000,50",
                          "Bilal Alaoui ; 2000"])
    write(src / "b.txt", ["EMPLOYER: Beta ; ACTIVITY: Retail ; CITY: Fes", "Amal Alaoui ; 700", "junk"])
    q = declaration_stream(spark, str(src), str(sink), str(ckpt))
    q.awaitTermination(120)
    star = load_ingested(spark, str(sink))
    assert star.salary_records.count() == 3
    assert star.employees.count() == 2          # Amal appears in both files
    write(src / "c.txt", ["EMPLOYER: Acme ; ACTIVITY: Tech ; CITY: Rabat", "Chama Tazi ; 3000"])
    q = declaration_stream(spark, str(src), str(sink), str(ckpt))   # same checkpoint: only c.txt
    q.awaitTermination(120)
    star = load_ingested(spark, str(sink))
    assert star.salary_records.count() == 4
    assert star.companies.count() == 2
    total = star.salary_records.agg(F.sum("salary_amount")).first()[0]
    assert float(total) == 1000.50 + 2000 + 700 + 3000
    rejects = spark.read.parquet(str(sink / "rejects")).where("status = 'unparsed'").count()
    assert rejects == 1


def test_second_run_continues_the_sink(spark, tmp_path):
    """Without a named checkpoint the sink's own one is used: the second run
    adds a batch instead of replacing the first."""
    src, sink = tmp_path / "in", tmp_path / "out"
    os.makedirs(src)
    write(src / "a.txt", ["EMPLOYER: Acme ; ACTIVITY: Tech ; CITY: Rabat", "Amal Alaoui ; 1000"])
    declaration_stream(spark, str(src), str(sink)).awaitTermination(120)
    write(src / "b.txt", ["EMPLOYER: Beta ; ACTIVITY: Retail ; CITY: Fes", "Bilal Alaoui ; 2000"])
    declaration_stream(spark, str(src), str(sink)).awaitTermination(120)
    star = load_ingested(spark, str(sink))
    assert sorted(float(r.salary_amount) for r in star.salary_records.collect()) == [1000.0, 2000.0]
    with pytest.raises(ValueError, match="checkpoint"):
        declaration_stream(spark, str(src), str(sink), str(tmp_path / "another"))


def test_a_correction_replaces_the_declaration(spark, tmp_path):
    """Filed again for the same employer and period under a new name, in a
    later batch: only the correction counts, a replayed batch changes
    nothing, and other periods and employers stay."""
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    os.makedirs(src)
    acme = "EMPLOYER: Acme ; ACTIVITY: Tech ; CITY: Rabat"
    write(src / "acme_2024_01.txt", [acme, "Amal Alaoui ; 1000", "Bilal Alaoui ; 2000"])
    write(src / "acme_2024_02.txt", [acme, "Amal Alaoui ; 1100"])
    write(src / "beta_2024_01.txt", ["EMPLOYER: Beta ; ACTIVITY: Retail ; CITY: Fes", "Chama Tazi ; 700"])
    declaration_stream(spark, str(src), str(sink), str(ckpt)).awaitTermination(120)
    write(src / "correction_acme_2024-01.txt", [acme, "Amal Alaoui ; 1050"])
    declaration_stream(spark, str(src), str(sink), str(ckpt)).awaitTermination(120)

    def state():
        star = load_ingested(spark, str(sink))
        people = star.salary_records.join(star.employees, "employee_id").select("full_name", F.col("salary_amount").cast("double"))
        return sorted(map(tuple, people.collect())), star.documents.count(), {r.status: r.row_count for r in load_audit(spark, str(sink)).collect()}

    people, documents, audit = state()
    assert people == [("Amal Alaoui", 1050.0), ("Amal Alaoui", 1100.0), ("Chama Tazi", 700.0)]
    assert documents == 3 and audit["superseded"] == 2 and audit["loaded"] == 3 and audit["header"] == 4
    batch = spark.read.parquet(str(sink / "filings")).where("batch = 1")
    assert [r.period for r in batch.collect()] == ["2024-01"]
    # a batch that is written a second time replaces its own folder
    for name in ("filings", "salary_records"):
        rows = spark.read.parquet(str(sink / name / "batch_id=1"))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        rows.write.mode("overwrite").parquet(str(sink / name / "batch_id=1"))
    assert state() == (people, documents, audit)
    # a correction that takes all lines back still stands
    write(src / "z_acme_2024_02.txt", [acme])
    declaration_stream(spark, str(src), str(sink), str(ckpt)).awaitTermination(120)
    assert state()[0] == [("Amal Alaoui", 1050.0), ("Chama Tazi", 700.0)]


def test_of_one_batch_the_last_file_stands(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    os.makedirs(src)
    head = "EMPLOYER: Acme ; ACTIVITY: Tech ; CITY: Rabat"
    for i, name in enumerate(["z_2024_03.txt", "a_2024_03.txt"]):
        write(src / name, [head, f"Amal Alaoui ; {1000 + i}"])
        os.utime(src / name, (1_700_000_000 + 60 * i,) * 2)
    declaration_stream(spark, str(src), str(sink)).awaitTermination(120)
    star = load_ingested(spark, str(sink))
    assert [float(r.salary_amount) for r in star.salary_records.collect()] == [1001.0]  # filed later
