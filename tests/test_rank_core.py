"""Distributed rank core vs brute force: ties, NULLs, negatives, groups
(including a NULL group), and a hot value holding a third of the rows."""

import random
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salarium.operators.aggregates import sq_dev, stddev_samp_of
from salarium.operators.generate import digest_bits
from salarium.operators.inequality import inequality
from salarium.operators.ranks import (double_bucket, expand_rows, frame_from_hist, hash_bucket, lorenz_curve, lorenz_points,
                                      ntile, ntile_pieces, quantiles, rank_frame)
from tests import brute

PROBS = {"p0": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p1": 1.0}


def dec_df(spark, xs, groups=None):
    rows = [(g, None if x is None else f"{x:.2f}") for g, x in zip(groups or [None] * len(xs), xs)]
    return spark.createDataFrame(rows, "g string, x string").select(
        "g", F.col("x").cast("decimal(15,2)").alias("x"))


def sample(seed, n=300):
    r = random.Random(seed)
    hot = round(r.uniform(1, 500), 2)
    xs = [hot] * (n // 3) + [round(r.choice([r.uniform(-50, 50), r.uniform(1, 1e5)]), 2)
                             for _ in range(n - n // 3)]
    xs += [r.choice(xs) for _ in range(n // 5)]          # more ties
    r.shuffle(xs)
    return xs


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_percent_rank_ntile(spark, seed):
    xs = sample(seed) + [None, None]
    rf = rank_frame(dec_df(spark, xs), "x")
    q = quantiles(rf, PROBS).collect()[0]
    vals = [x for x in xs if x is not None]
    for k, p in PROBS.items():
        assert q[k] == pytest.approx(brute.percentile_cont(vals, p), abs=1e-6)
    pr = {float(r.v) if r.v is not None else None: r.pr
          for r in rf.df.select("v", rf.percent_rank().alias("pr")).collect()}
    exp = brute.percent_rank(xs)
    assert set(pr) == set(exp)
    for k, v in exp.items():
        assert pr[k] == pytest.approx(v, abs=1e-12)
    pieces = {(float(r.v), r.tile): r.rows for r in ntile_pieces(rank_frame(dec_df(spark, vals), "x"), 10)
              .where("rows > 0").collect()}
    assert pieces == brute.ntile_counts(vals, 10)


def test_grouped_with_null_group(spark):
    r = random.Random(7)
    xs = [round(r.uniform(1, 1000), 2) for _ in range(400)]
    gs = [r.choice(["a", "b", None, "hot", "hot", "hot"]) for _ in range(400)]
    rf = rank_frame(dec_df(spark, xs, gs), "x", ["g"])
    got = {r.g: r.p50 for r in quantiles(rf, {"p50": 0.5}).collect()}
    for g in set(gs):
        exp = brute.percentile_cont([x for x, gg in zip(xs, gs) if gg == g], 0.5)
        assert got[g] == pytest.approx(exp, abs=1e-6)
    ineq = {r.g: r for r in inequality(rf, digits=None).collect()}
    for g in set(gs):
        sub = [x for x, gg in zip(xs, gs) if gg == g]
        assert ineq[g].gini == pytest.approx(brute.gini(sub), abs=1e-9)


def test_lorenz_points_and_expand(spark):
    xs = sample(3, 120)
    rf = rank_frame(dec_df(spark, xs), "x")
    v = sorted(xs)
    n, tot = len(v), sum(v)
    pts = {r.i: (r.x, r.y) for r in lorenz_points(rf, 10).collect()}
    want = sorted({j * (n - 1) // 10 for j in range(11)})
    assert sorted(pts) == want
    for i in want:
        assert pts[i][0] == pytest.approx(i / (n - 1))
        assert pts[i][1] == pytest.approx(sum(v[:i + 1]) / tot)
    rows = expand_rows(rf, chunk=7).select("pos", F.col("v").cast("double").alias("v")).collect()
    assert sorted(r.pos for r in rows) == list(range(n))
    assert sorted((r.pos, r.v) for r in rows) == [(i, x) for i, x in enumerate(v)]


def test_ntile_small_n(spark):
    xs = [5.0, 1.0, 3.0]          # fewer rows than tiles
    t = {r.tile: r.rows for r in ntile(rank_frame(dec_df(spark, xs), "x"), 10).collect()}
    assert t == {1: 1, 2: 1, 3: 1}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-300, max_value=3000), min_size=1, max_size=60))
def test_property_against_brute(spark, ints):
    xs = [i / 4 for i in ints]   # exact in cents
    rf = rank_frame(dec_df(spark, xs), "x")
    q = quantiles(rf, {"m": 0.5, "p9": 0.9}).collect()[0]
    assert q.m == pytest.approx(brute.percentile_cont(xs, 0.5), abs=1e-9)
    assert q.p9 == pytest.approx(brute.percentile_cont(xs, 0.9), abs=1e-9)
    d = {r.tile: r.rows for r in ntile(rf, 10).collect()}
    assert sum(d.values()) == len(xs)
    assert max(d.values()) - min(d.values()) <= 1
    g = inequality(rf, digits=None).collect()[0]
    assert g.gini == pytest.approx(brute.gini(xs), abs=1e-9)
    if min(xs) >= 0:
        assert -1e-9 <= g.gini <= 1 and 0 <= g.hoover <= 1


def test_double_values_use_quantile_buckets(spark):
    xs = [random.Random(5).uniform(0, 10) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = quantiles(rank_frame(df, "x"), {"p50": 0.5}).collect()[0]
    assert q.p50 == pytest.approx(brute.percentile_cont(xs, 0.5), abs=1e-12)


def test_wide_decimals_and_extreme_values(spark):
    df = spark.createDataFrame([(D("25.25"),), (D("99999999999999999999.5"),), (D("-3.125"),), (None,)], "x decimal(38,18)")
    q = quantiles(rank_frame(df, "x"), {"p50": 0.5}).first()
    assert q.p50 == 25.25
    longs = spark.createDataFrame([(-2 ** 63,), (-2 ** 63 + 1,), (0,), (2 ** 62,)], "x long")
    pre = {r.v: r.pre for r in rank_frame(longs, "x").df.select("v", "pre").collect()}
    assert pre == {-2 ** 63: 0, -2 ** 63 + 1: 1, 0: 2, 2 ** 62: 3}


def test_double_buckets_are_monotone(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 1.0, 2.0, 4.0, 8.0, float("inf"), -float("inf")]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", double_bucket(F.col("v")).alias("b"))
    rows = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_hash_buckets_shrink_with_partitions(spark):
    rows = spark.range(20000).select(digest_bits(15, 1, "order", F.col("id")).alias("v"))
    most = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (8, 512):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            most.append(rows.groupBy(hash_bucket(rows, F.col("v")).alias("b")).count().agg(F.max("count")).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert most[0] <= 20000 / 256 * 2 and most[1] <= 20000 / 2048 * 4


def test_stddev_takes_one_path_at_any_size(spark):
    """10^12 rows of large salaries as a histogram: no overflow, no other formula."""
    hist = spark.createDataFrame([(D("90000.00"), 5 * 10 ** 11), (D("110000.00"), 5 * 10 ** 11)], "v decimal(15,2), f long")
    rf = frame_from_hist(hist)
    got = rf.df.agg(stddev_samp_of(F.max("n"), sq_dev(F.col("v"), F.col("f"))).alias("s")).first().s
    assert abs(got - 10000.0) < 1e-4


def test_full_lorenz_curve(spark):
    df = spark.createDataFrame([(D(v),) for v in ("1", "1", "2", "4", "4", "4")], "x decimal(15,2)")
    got = [(r.i, round(r.y, 12)) for r in lorenz_curve(rank_frame(df, "x")).orderBy("i").collect()]
    assert got == [(0, round(1 / 16, 12)), (1, 0.125), (2, 0.25), (5, 1.0)]


@pytest.mark.parametrize("kind", ["decimal(15,2)", "long", "double", "decimal(38,3)"])
def test_group_figures_against_brute_force(spark, kind):
    """Moments and percentiles by buckets: negative values, ties, a group of
    near-equal large values, single values, a null group."""
    import random
    import statistics

    from salarium.operators.aggregates import group_figures, stddev_samp_of
    from salarium.operators.ranks import quantile_value
    rng = random.Random(9)
    whole = kind == "long"
    groups = {"mixed": [rng.uniform(-500, 500) for _ in range(400)], "ties": [7.0] * 50 + [8.0] * 3, "one": [3.0], "zero": [0.0, 0.0, -1.0],
              "near": [1e9 + i % 7 for i in range(200)], None: [rng.uniform(1, 9) for _ in range(30)]}
    rows = [(g, float(round(v)) if whole else round(v, 2)) for g, vs in groups.items() for v in vs]
    names = list(groups)
    df = spark.createDataFrame([(names.index(g), v) for g, v in rows], "g long, x double").select("g", F.col("x").cast(kind).alias("v"))
    hist = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("f"))
    probs = {"low": 0.0, "q": 0.25, "m": 0.5, "top": 0.99, "high": 1.0}
    out = group_figures(hist, probs).select("g", "_n", "_s1", "_min", "_max", stddev_samp_of(F.col("_n"), F.col("_d2")).alias("sd"),
                                                  *[quantile_value(p).alias(p) for p in probs]).collect()
    assert len(out) == len(groups)
    for r in out:
        vs = sorted(v for g, v in rows if g == names[r["g"]])
        assert r["_n"] == len(vs) and float(r["_min"]) == vs[0] and float(r["_max"]) == vs[-1]
        assert abs(float(r["_s1"]) - sum(vs)) < 1e-6 * max(1, abs(sum(vs)))
        if len(vs) > 1:
            # doubles lose the digits that a cluster shares
            loss = 0 if kind in ("long", "decimal(15,2)") else 1e-9 * abs(vs[0])
            assert abs(r["sd"] - statistics.stdev(vs)) < 1e-7 * max(1, statistics.stdev(vs)) + loss, (kind, r["g"])
        else:
            assert r["sd"] is None
        for name, p in probs.items():
            k = p * (len(vs) - 1)
            lo = int(k)
            want = vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (k - lo)
            assert abs(r[name] - want) < 1e-6, (kind, r["g"], name)
