"""Invariants of the hash-seeded generators (no value oracle exists)."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from salarium.operators.generate import (PAY_TIERS, keyed_place, document_headcounts, random_order_in_company,
                                         synthetic_assignments, with_places)
from salarium.sources.star import load_tpch_star
from tests.conftest import SF001


def test_headcounts_and_assignments(spark):
    star = load_tpch_star(spark, SF001)
    docs = document_headcounts(star.companies)
    d = {r.company_id: r for r in docs.collect()}
    assert len(d) == star.companies.count()
    for cid, r in d.items():
        lo, hi = (15, 49) if cid <= 5 else (5, 19) if cid <= 15 else (2, 9)
        assert lo <= r.employee_count <= hi
        assert r.filename == f"DECL_{cid}_2024_01.pdf"
    a = synthetic_assignments(docs, star.employees).cache()
    per = {r.company_id: (r.n, r.u, r.mx) for r in a.groupBy("company_id").agg(
        F.count("*").alias("n"), F.countDistinct("employee_id").alias("u"), F.max("emp_num").alias("mx")).collect()}
    for cid, (n, u, mx) in per.items():
        assert n == d[cid].employee_count == u == mx
    lo = min(min(b for _, b, _ in br) for br, _ in PAY_TIERS.values())
    hi = max(b + s for br, _ in PAY_TIERS.values() for _, b, s in br)
    s = a.agg(F.min("salary_amount"), F.max("salary_amount")).first()
    assert float(s[0]) >= 3000 and float(s[1]) <= hi and lo > 0
    # deterministic: a second evaluation gives the same rows
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, synthetic_assignments(docs, star.employees).collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 10, 97, 1000])
def test_each_key_has_a_permutation(spark, size):
    df = spark.range(size).crossJoin(spark.range(3).toDF("c")).withColumn("e", F.lit(size).cast("long"))
    got = df.select("c", "id", keyed_place("id", "c", "e", 42).alias("p")).collect()
    orders = [tuple(r["p"] for r in sorted(got, key=lambda r: r["id"]) if r["c"] == c) for c in range(3)]
    assert all(sorted(o) == list(range(size)) for o in orders)
    assert size < 10 or len(set(orders)) == 3


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_compiled_places_are_the_same(spark, size):
    df = spark.range(size).crossJoin(spark.range(3).toDF("c")).withColumn("e", F.lit(size).cast("long"))
    got = with_places(df, "id", "c", "e", 42).withColumn("p", keyed_place("id", "c", "e", 42))
    assert got.count() == 3 * size and got.where("position != p OR position IS NULL").count() == 0


def test_rosters_overlap_as_chance_predicts(spark):
    """Two companies that draw h of E people share h^2 / E of them on
    average, and neighbours of one roster are not neighbours in another."""
    E, h, n = 400, 40, 120
    docs = spark.range(n).select(F.col("id").alias("document_id"), F.col("id").alias("company_id"), F.lit(h).alias("employee_count"))
    rows = synthetic_assignments(docs, spark.range(E).toDF("employee_id")).collect()
    rosters = {}
    for r in rows:
        rosters.setdefault(r.company_id, {})[r.emp_num] = r.employee_id
    sets = [set(x.values()) for x in rosters.values()]
    shared = [len(a & b) for a, b in combinations(sets, 2)]
    mean = sum(shared) / len(shared)
    assert abs(mean - h * h / E) < 0.1  # 7140 pairs of deviation about 1.7
    spread = sum((x - mean) ** 2 for x in shared) / len(shared)
    want = h * h / E * (1 - h / E) * (E - h) / (E - 1)  # hypergeometric
    assert 0.8 < spread / want < 1.25
    held = Counter(e for s in sets for e in s)
    assert len(held) == E and max(held.values()) < 3 * n * h / E
    neighbours = Counter((x[i], x[i + 1]) for x in rosters.values() for i in range(1, h))
    assert max(neighbours.values()) <= 4


def test_random_order_is_permutation(spark):
    star = load_tpch_star(spark, SF001)
    pairs = star.records("company_id", "employee_id").where(F.col("company_id").isNotNull())
    r = random_order_in_company(pairs)
    bad = (r.groupBy("company_id").agg(F.count("*").alias("n"), F.countDistinct("emp_num").alias("d"),
                                       F.min("emp_num").alias("lo"), F.max("emp_num").alias("hi"))
            .where("n != d OR lo != 1 OR hi != n").count())
    assert bad == 0
    assert r.count() == pairs.distinct().count()
