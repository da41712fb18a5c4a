"""The similarity join against all pairs, and its plan."""

import random
from itertools import combinations, product

import pytest

from salarium.operators.fuzzy import term_trigrams
from salarium.operators.fuzzy_join import fuzzy_pairs, link_counts, members

WORDS = ["atlas", "atlantic", "maroc", "telecom", "telekom", "banque", "bank", "sud", "nord", "Énergie", "energie", "sa", "s.a.", "x"]


def names(seed, n):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return out + ["", None, "--", "a", "A", "ab", "Banque  Sud", "banque sud", "BANQUE-SUD"] + ["telecom maroc"] * 6


def similar(a, b, t):
    x, y = set(term_trigrams(a)), set(term_trigrams(b))
    s = round(len(x & y) / len(x | y), 8) if x and y else 0
    return s if x and y and s >= t else None


def first_keys(rows):
    keys = {}
    for k, text in rows:
        if text is not None:
            keys[text] = min(k, keys.get(text, k))
    return keys


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_pairs_of_one_table(spark, threshold, hot):
    rows = list(enumerate(names(1, 120)))
    df = spark.createDataFrame(rows, "id long, name string")
    got = sorted(map(tuple, fuzzy_pairs(df, "id", "name", threshold, hot=hot).collect()))
    keys = first_keys(rows)
    want = [(*sorted((keys[a], keys[b])), similar(a, b, threshold)) for a, b in combinations(keys, 2) if similar(a, b, threshold) is not None]
    assert got == sorted(want) and want


@pytest.mark.parametrize("hot", [0, 10_000])
def test_pairs_of_two_tables(spark, hot):
    left, right = list(enumerate(names(2, 60))), list(enumerate(names(3, 70), 1000))
    a, b = spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "no long, label string")
    got = sorted(map(tuple, fuzzy_pairs(a, "id", "name", 0.6, b, "no", "label", hot=hot).collect()))
    ka, kb = first_keys(left), first_keys(right)
    want = sorted((ka[x], kb[y], similar(x, y, 0.6)) for x, y in product(ka, kb) if similar(x, y, 0.6) is not None)
    assert got == want and want


def test_every_row_has_its_class_and_links(spark):
    rows = list(enumerate(names(1, 50)))
    df = spark.createDataFrame(rows, "id long, name string")
    out = link_counts(fuzzy_pairs(df, "id", "name", 0.5), members(df, "id", "name"), "id").collect()
    keys = first_keys(rows)
    assert len(out) == sum(t is not None for _, t in rows)
    for r in out:
        text = rows[r["id"]][1]
        assert r["class_key"] == keys[text] and r["class_size"] == sum(t == text for _, t in rows)
        assert r["links"] == sum(similar(text, t, 0.5) is not None for t in keys if t != text)


def test_no_all_pairs_and_hot_grams_are_split(spark):
    """Every name holds the same word: its grams are hot, and no key holds
    more than a few names."""
    from pyspark.sql import functions as F

    from salarium.operators.fuzzy_join import gram_sets, ordered, posted
    df = spark.range(2000).select("id", F.concat(F.lit("Customer "), F.sha2(F.col("id").cast("string"), 256).substr(1, 8)).alias("name"))
    plan = fuzzy_pairs(df, "id", "name", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    sets = gram_sets(df, "id", "name").withColumn("side", F.lit(0))

    def largest(hot, smaller):
        return posted(ordered(sets, hot), 0.5, smaller).groupBy("k1", "k2").count().agg(F.max("count")).first()[0]
    # the word is in the prefixes of the larger sets only, and once its grams
    # are split, no key holds as many as a tenth of the names
    assert largest(10_000, False) == 2000 and largest(10_000, True) < 200
    assert largest(100, True) < 200
    sizes = {r["k"]: r["count"] for r in posted(ordered(sets, 100), 0.5, True).groupBy(F.concat_ws("+", "k1", "k2").alias("k")).count().collect()}
    large = {r["k"]: r["count"] for r in posted(ordered(sets, 100), 0.5, False).groupBy(F.concat_ws("+", "k1", "k2").alias("k")).count().collect()}
    met = sum(sizes[k] * large.get(k, 0) for k in sizes)
    assert met < 2000 * 2000 / 10


def test_no_grams_travel_to_the_join_and_signatures_bound_the_difference(spark):
    from pyspark.sql import functions as F

    from salarium.operators.fuzzy_join import SIGNATURE, gram_sets, ordered, signed
    rows = [(i, x) for i, x in enumerate([*names(5, 60), "\u4e2d\u6587\U00020000", "\u4e2d\u6587\U00020001"]) if x]
    df = spark.createDataFrame(rows, "id long, name string")
    plan = fuzzy_pairs(df, "id", "name", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    keyed = [x for x in plan.splitlines() if "xxhash64(" in x and " AS h#" in x]
    assert len(keyed) == 2 and not any("grams" in x for x in keyed)
    sets = signed(ordered(gram_sets(df, "id", "name").withColumn("side", F.lit(0)), 10)).collect()
    assert all([tuple(map(ord, g)) for g in r["grams"]] == [(c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) for c in r["codes"]] for r in sets)
    for a, b in combinations(sets, 2):
        bits = sum(((a[f"s{w}"] ^ b[f"s{w}"]) % (1 << 64)).bit_count() for w in range(SIGNATURE))
        assert bits <= len(set(a["grams"]) ^ set(b["grams"]))
