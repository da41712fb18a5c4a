"""SimHash, the Gray index and components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from salarium.llm import simhash as S
from salarium.llm.components import connected_components
from salarium.llm.gray import GrayIndex, gray_rank
from tests.conftest import SF001
from tests.llm import data


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    codes = sorted({plain(t) for _, t in rows})
    root = data.union_roots(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[plain(t)]
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{plain(t):016x}", least.get(root[plain(t)])) for i, t in rows), key=repr)


@pytest.mark.parametrize("parts", [None, 7])
def test_classes_of_odd_rows(spark, tmp_path, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(S, "RANGES", parts)
    docs = data.odd_docs(spark, tmp_path)
    got = sorted((tuple(r) for r in S.simhash_classes(docs).collect()), key=repr)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = S.keep_one(docs)
    codes = sorted({int(r[1], 16) for r in got})
    classes = set(data.union_roots(codes, lambda a, b: (a ^ b).bit_count() <= 2).values())
    assert kept.columns == docs.columns and kept.count() == len(classes)


def test_classes_of_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted((tuple(r) for r in S.simhash_classes(docs).collect()), key=repr)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_no_documents(spark, tmp_path):
    docs = data.no_docs(spark, tmp_path)
    assert S.simhash_classes(docs).count() == 0 and S.keep_one(docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 400), st.integers(1, 64), st.integers(0, 4))
def test_gray_index_finds_every_pair(seed, n, bits, limit):
    rng = np.random.default_rng(seed)
    codes = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64((1 << bits) - 1))
    index = GrayIndex(codes)
    found = {(int(q), int(index.codes[c])) for a, b in index.search(codes, limit) for q, c in zip(codes[a], b)}
    assert found == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= limit}


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(7, 7), (5, 4), (4, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(200, 260)]}, 4: 4, 5: 4}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
