import pytest

from salarium.operators.fuzzy import fuzzy_search, similarity
from tests import brute

NAMES = ["red widget", "blue widgets", "small ring", "Widget-Co 2", "w", "", "Ünïcode Name"]


def test_similarity_matches_definition(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    from pyspark.sql import functions as F
    got = {r.name: r.s for r in df.select("name", similarity(F.col("name"), "widgets").alias("s")).collect()}
    for n in NAMES:
        assert got[n] == pytest.approx(brute.similarity(n, "widgets"))


def test_threshold(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    hits = {r.name for r in fuzzy_search(df, "name", "widgets").collect()}
    assert hits == {n for n in NAMES if brute.similarity(n, "widgets") >= 0.3}
