"""The reference's own unit tests (Gini ordering, Hoover bounds) plus the
expected values of FIXTURES.md section 1, run through the distributed
operators and checked against the numpy definitions."""

import pytest
from pyspark.sql import functions as F

from salarium.operators.inequality import inequality_of
from tests import brute


def measures(spark, xs, eps=0.5):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    df = df.select(F.col("x").cast("decimal(15,2)").alias("x"))
    return inequality_of(df, "x", epsilon=eps, digits=None).collect()[0]


def test_gini_ordering(spark):
    assert measures(spark, [10, 10, 10, 10]).gini < measures(spark, [1, 1, 1, 100]).gini


def test_hoover_bounds(spark):
    h = measures(spark, [5, 5, 5, 5]).hoover
    assert 0 <= h <= 1


@pytest.mark.parametrize("xs", [[10, 10, 10, 10], [1, 1, 1, 100], [5, 5, 5, 5],
                                [-5, 0, 3, 10], [0, 0, 0], [3], [1, 2, 2, 2, 9, 9, 40]])
def test_against_numpy(spark, xs):
    r = measures(spark, xs)
    assert r.gini == pytest.approx(brute.gini(xs), abs=1e-12)
    assert r.hoover == pytest.approx(brute.hoover(xs), abs=1e-12)
    assert r.atkinson == pytest.approx(brute.atkinson(xs), abs=1e-12)
    r1 = measures(spark, xs, eps=1)
    assert r1.atkinson == pytest.approx(brute.atkinson(xs, 1), abs=1e-12)


def test_fixture_values(spark):
    r = measures(spark, [1, 1, 1, 100])
    assert r.gini == pytest.approx(0.720874, abs=1e-6)
    assert r.hoover == pytest.approx(0.720874, abs=1e-6)
    assert r.atkinson == pytest.approx(0.589805, abs=1e-6)
    z = measures(spark, [10, 10, 10, 10])
    assert (z.gini, z.hoover) == (pytest.approx(0, abs=1e-12), 0.0)
    assert z.atkinson == pytest.approx(0, abs=1e-12)


def test_empty_input(spark):
    df = spark.createDataFrame([], "x decimal(15,2)")
    r = inequality_of(df, "x").collect()
    assert [tuple(x) for x in r] == [(0, None, 0.0, 0.0)]
