from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from salarium.sources.ingest import STATUSES, check_collisions, key_collisions, parse_amount, parse_declarations
from salarium.sources.star import Star

LINES = [
    ("a.txt", "EMPLOYER: Acme  SA ; ACTIVITY: Tech ; CITY: Rabat"),
    ("a.txt", "Amal   Alaoui ; 12 345,67 MAD"),
    ("a.txt", "Amal Alaoui ; 12 345,67"),            # duplicate after cleaning
    ("a.txt", "Bilal Alaoui ; 9,876.50"),
    ("a.txt", "Chama ; 12x"),                        # bad amount
    ("a.txt", "total page 3"),                       # unparsed
    ("a.txt", "   "),                                # blank
    ("b.txt", "Driss ; 100"),                        # no header in file
    ("c.txt", "EMPLOYER: Beta ; ACTIVITY: ; CITY: "),
    ("c.txt", "Driss ; 3000.5"),
]


def test_parse_amount(spark):
    vals = ["12 345,67", "12,345.67", "12345.67", "1.234,5", "100", "12x", "1,2,3", "3000.5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.a for r in df.select(parse_amount(F.col("s")).alias("a")).collect()]
    assert got == [D("12345.67"), D("12345.67"), D("12345.67"), D("1234.50"), D("100.00"), None, None,
                   D("3000.50")]


def test_ambiguous_amounts_need_a_convention(spark):
    df = spark.createDataFrame([(v,) for v in ["7,500", "1.500", "12.345", "1,234.50", "1500,5"]], "s string")
    got = [[r.a for r in df.select(parse_amount(F.col("s"), mark).alias("a")).collect()] for mark in (None, ".", ",")]
    assert got[0] == [None, None, None, D("1234.50"), D("1500.50")]
    assert got[1] == [D("7500.00"), D("1.50"), D("12.35"), D("1234.50"), None]
    assert got[2] == [D("7.50"), D("1500.00"), D("12345.00"), None, D("1500.50")]


def test_every_line_has_one_status(spark):
    odd = LINES + [
        ("d.txt", "EMPLOYER:  ; ACTIVITY: X ; CITY: Y"), ("d.txt", "Emma ; 10"),                       # no employer
        ("e.txt", "EMPLOYER: One ; ACTIVITY: X ; CITY: Y"), ("e.txt", "EMPLOYER: Two ; ACTIVITY: X ; CITY: Y"), ("e.txt", "Emma ; 10"),
        ("f.txt", "EMPLOYER: Gone ; ACTIVITY: X ; CITY: Y"), ("f.txt", "Emma ; 7,500"), ("f.txt", "Emma ; x1"),   # all rejected
        ("g.txt", None)]
    res = parse_declarations(spark.createDataFrame(odd, "filename string, line string"))
    audit = {r.status: r.row_count for r in res.audit.collect()}
    assert sum(audit.values()) == len(odd)
    assert audit == {"header": 3, "loaded": 3, "duplicate": 1, "blank": 2, "bad_header": 1, "extra_header": 2, "missing_header": 3,
                     "bad_amount": 2, "ambiguous_amount": 1, "unparsed": 1}
    docs = {r.filename: (r.employee_count, r.total_salary_mass) for r in res.star.documents.collect()}
    assert docs["f.txt"] == (0, D("0.00")) and set(docs) == {"a.txt", "c.txt", "f.txt"}
    assert all(r.company_name for r in res.star.companies.collect())
    assert res.rejects.count() == sum(audit[k] for k in STATUSES[4:])


def test_shared_ids_fail_the_load(spark):
    star = parse_declarations(spark.createDataFrame(LINES, "filename string, line string")).star
    twice = Star(star.companies, star.documents, star.employees.unionAll(star.employees), star.salary_records)
    check_collisions(key_collisions(star))
    with pytest.raises(ValueError, match="employees"):
        check_collisions(key_collisions(twice))


def test_parse_declarations(spark):
    res = parse_declarations(spark.createDataFrame(LINES, "filename string, line string"))
    audit = {r.status: r.row_count for r in res.audit.collect()}
    assert audit == {"header": 2, "loaded": 3, "duplicate": 1, "bad_amount": 1, "unparsed": 1,
                     "blank": 1, "missing_header": 1}
    recs = {(r.salary_amount) for r in res.star.salary_records.collect()}
    assert recs == {D("12345.67"), D("9876.50"), D("3000.50")}
    comps = {(r.company_name, r.activity_description, r.city) for r in res.star.companies.collect()}
    assert comps == {("Acme SA", "Tech", "Rabat"), ("Beta", None, None)}
    emps = {r.full_name for r in res.star.employees.collect()}
    assert emps == {"Amal Alaoui", "Bilal Alaoui", "Driss"}
    docs = {r.filename: (r.employee_count, r.total_salary_mass) for r in res.star.documents.collect()}
    assert docs == {"a.txt": (2, D("22222.17")), "c.txt": (1, D("3000.50"))}
    assert all(r.colliding_keys == 0 for r in res.collisions.collect())
    assert {r.status for r in res.rejects.collect()} == {"bad_amount", "unparsed", "missing_header"}


def test_every_line_is_read_once_for_all_tables(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for r in rows:
            seen.add(1)
            yield r
    lines = spark.createDataFrame(spark.sparkContext.parallelize(LINES, 2).mapPartitions(told), "filename string, line string")
    res = parse_declarations(lines)
    for df in (*res.star.tables().values(), res.rejects, res.audit, res.collisions):
        df.collect()
    assert seen.value == len(LINES)
