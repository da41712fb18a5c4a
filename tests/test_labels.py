"""Display labels."""

from pyspark.sql import functions as F

from salarium.functions.labels import magnitude_label, money_axis_label, or_unknown, truncate_label


def test_magnitude_and_axis_labels(spark):
    df = spark.createDataFrame([(900.0,), (1500.0,), (30000.0,), (2500000.0,)], "x double")
    got = [tuple(r) for r in df.select(magnitude_label("x"), money_axis_label("x")).collect()]
    assert got == [("900", "900 MAD"), ("1.5K", "2K MAD"), ("30.0K", "30K MAD"), ("2.50M", "2.5M MAD")]


def test_text_labels(spark):
    df = spark.createDataFrame([("short",), ("a longer label",), ("",), (None,)], "x string")
    got = [tuple(r) for r in df.select(truncate_label("x", 8, 5), or_unknown(F.col("x"))).collect()]
    assert got == [("short", "short"), ("a lon...", "a longer label"), ("", "Unknown"), (None, "Unknown")]
