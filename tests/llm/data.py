"""Small fixtures with every odd case, written as tables and read back."""

import itertools
import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, hash string, copies int, part int, "
          "code string, position int, shard string, `a.b` int, doc string, row string, start int, score double, k1 int")

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    texts = [None, "", " \t\n", "one", "one two", "ONE  two", sentence(rng, 4000), "x" * 200_000, shared,
             "before " + shared + " behind", shared + "!", "é" * 150, "ab" * 300, "token = abcdefghijklmnop AKIA" + "Q" * 14,
             "you IDIOT and m0ron", "Licensed under the Apache License, Version 2.0."]
    texts += [sentence(rng, rng.randrange(1, 40)) for _ in range(20)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [(8, shared, "en", "src0")] * 12  # repeated rows
    rows += [(None, shared, None, None), (None, None, None, None), (3, "another text of an id that is taken", "de", "src1")]
    return [(*r, len(r[1] or ""), 1, "h", 2, 3, "c", 4, "s", 5, "d", "r", 6, 0.5, 7) for r in rows]


def write(spark, path, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def odd_docs(spark, tmp_path):
    return write(spark, tmp_path / "documents.parquet", odd_rows(), SCHEMA)


def no_docs(spark, tmp_path):
    return write(spark, tmp_path / "documents.parquet", [], SCHEMA, 1)


def union_roots(items, linked):
    """Smallest item that each is linked to, by exhaustive pairs."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}
