"""Decontamination, toxicity, licenses and suffix dedup."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salarium.llm import decontaminate as D
from salarium.llm import induced
from salarium.llm import license_scan as L
from salarium.llm import queries as Q
from salarium.llm import suffix_dedup as X
from salarium.llm import toxicity as T
from tests.conftest import SF001, SF01
from tests.llm import data


def shingles(text):
    words = D.normal((text or "").encode()).split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def contained(docs, items):
    distinct = {}
    for i, t in items:
        if t is not None and shingles(t):
            distinct[t] = min(distinct.get(t, i), i)
    return sorted(((d, i, len(shingles(x) & shingles(t)) / len(shingles(x))) for d, t in docs for x, i in distinct.items()
                   if len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))), key=repr)


@pytest.mark.parametrize("piece", [None, 64])
def test_contamination_of_odd_rows(spark, tmp_path, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(D, "PIECE", piece)
    docs = data.odd_docs(spark, tmp_path)
    rng = random.Random(1)
    shared = data.sentence(rng, 60)
    items = [(1, shared), (9, shared), (2, shared[:200]), (3, "ONE, two!"), (4, None), (5, ""), (6, " ".join(shared.split()[5:30]) + " odd end"),
             (7, data.sentence(rng, 4000)[-400:]), (8, "nothing of this is in any document at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r)[:3] for r in D.contaminated(docs, table).collect()), key=repr)
    assert got == contained(rows, items) and any(i == 3 for _, i, _ in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    sql = f"SELECT doc_id, item_id, containment FROM ({Q.op6_sql()})"
    assert sorted((tuple(r) for r in con.execute(sql).fetchall()), key=repr) == got
    clean = D.decontaminate(docs, table)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for d in rows if not contained([d], items))


def test_contamination_in_blocks_and_empty_tables(spark, tmp_path, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    want = contained([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r)[:3] for r in D.contaminated(docs, items).collect()), key=repr) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert sorted((tuple(r)[:3] for r in D.contaminated(docs, items).collect()), key=repr) == want
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert D.contaminated(data.no_docs(spark, tmp_path), items).count() == 0


def test_folding():
    assert T.folded("Ïd10t, 5tup1d $$$ m0ron### МОRОN wh@t ２") .split() == ["idiot", "stupid", "moron", "moron", "what"]


def test_disguised_words():
    a = T.Model({f" {w} ": 4.0 for w in (*T.BASE, "shit")}, (" guinea pig ",)).automaton()
    for odd, word in (("asshol3", "asshole"), ("imbecil3!", "imbecile"), ("worthle55", "worthless"), ("455hole", "asshole"), ("1d10t", "idiot"),
                      ("5h1t", "shit"), ("!idiot", "idiot"), ("(455h0l3)$$$", "asshole")):
        assert T.disguised(a, f"you {odd} there") == {word: 4.0}, odd
    assert T.disguised(a, "idiot! m0ron 12 8 clean! guinea !pig mp3") == {}
    assert T.measures(a, T.folded("you 1d10t"), T.disguised(a, "you 1d10t")) > T.measures(a, T.folded("you 1d10t"))


def test_exceptions_and_length():
    a = T.Model({" trash ": 4.0, " idio": 2.0}, (" trash can ",)).automaton()
    assert T.hits(a, T.folded("a trash can")) == {} and list(T.hits(a, T.folded("trash! idiots")).values()) == [4.0, 2.0]
    assert T.measures(a, T.folded("trash"))[1] > T.measures(a, T.folded("trash " + "word " * 50))[1]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.toxicity(docs, T.train_model(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"] == 1)
    wrong = sum(r["predicted"] for r in rows if r["toxic"] == 0)
    assert scored.count() == docs.count() and caught >= 8 and wrong <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_of_odd_rows(spark, tmp_path):
    docs = data.odd_docs(spark, tmp_path)
    labels = spark.createDataFrame([(14, 1), (14, 0), (5, 0), (None, 1), (6, None), (7, 3)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = T.train_model(docs, known)
        out = T.toxicity(docs, model)
        assert out.count() == docs.count()
        assert [r["predicted"] for r in out.where("doc_id = 14").collect()] == [1]
        assert T.drop_toxic(docs, model).count() == docs.count() - out.where("predicted = 1").count()
    assert T.toxicity(data.no_docs(spark, tmp_path / "none"), T.Model({}, ())).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40))
def test_alignment_is_increasing_and_equal(a, b):
    pairs = L.align([str(x) for x in a], [str(x) for x in b])
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    once = [x for x in b if a.count(x) == 1 and b.count(x) == 1]
    if sorted(a) == sorted(b) == sorted(set(a)) and a == b:
        assert len(pairs) == len(a) == len(once)


def test_licenses(spark, tmp_path):
    mit = L.TEMPLATES["mit"]
    words = mit.split()
    changed = " ".join(w if k % 20 else "altered" for k, w in enumerate(words))
    rows = [(0, "intro é " + mit.upper() + " outro"), (1, changed), (2, " ".join(words[:60])), (3, None), (4, ""), (None, "Released under the MIT License."),
            (5, ("Released under the MIT License. " + "filler word " * 30) * 3)]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]): r for r in out}
    assert got[0, "mit"]["coverage"] == 1 and rows[0][1][got[0, "mit"]["start"]:got[0, "mit"]["end"]].startswith("PERMISSION")
    assert 0.9 < got[1, "mit"]["coverage"] < 1 and (2, "mit") not in got
    assert (None, "mit-notice") in got and got[5, "mit-notice"]["places"] == 3
    assert L.scan(data.no_docs(spark, tmp_path)).count() == 0
    assert {r["doc_id"] for r in L.scan(data.odd_docs(spark, tmp_path / "odd")).collect()} == {15}


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_each_license_is_found_as_itself(name):
    templates = [L.Template(n, t) for n, t in L.TEMPLATES.items()]
    text = "odd words before " + L.TEMPLATES[name] + " odd words behind"
    got = L.choose(templates, [w.lower() for w in L.WORDS.findall(text)])
    assert (name, 1.0) in [g[:2] for g in got]
    assert "disclaimer" not in text or "SUCH DAMAGE" in text or len(text) > 5000


def subsequence(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_places(words, template):
    """Largest number of disjoint stretches that hold the template, from
    every start and end."""
    good = [(e, s) for s in range(len(words)) for e in range(s + 1, min(len(words), s + 2 * len(template)) + 1)
            if subsequence(words[s:e], template) >= 0.8 * len(template)]
    free = count = 0
    for e, s in sorted(good):
        if s >= free:
            free, count = e, count + 1
    return count


def license_rows(text, name="apache-2.0-notice"):
    t = L.Template(name, L.TEMPLATES[name])
    words = [w.lower() for w in L.WORDS.findall(text)]
    got = t.find(words, [k for k, w in enumerate(words) if w in t.known])
    assert (got[3] if got else 0) == brute_places(words, t.words)
    return got


def test_licenses_after_headings_copies_and_damage():
    notice = L.TEMPLATES["apache-2.0-notice"]
    damaged = "Licensed under the Apache License, Version 3. "
    assert license_rows("Apache License, Version 2.0. " + notice) == (1.0, 5, 12, 1)
    assert license_rows(f"{notice} {notice}") == (1.0, 0, 7, 2)
    assert license_rows(f"{notice} " * 9)[3] == 9
    assert license_rows(damaged + notice) == (1.0, 7, 14, 1)
    assert license_rows("Licensed under the Apache License, Version 2.1. " + notice) == (1.0, 8, 15, 2)
    assert license_rows(damaged * 2) is None
    assert license_rows("Licensed under, the Apache Version. License notes: " + notice)[0] == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=8), st.lists(st.integers(0, 6), max_size=40))
def test_license_places_are_those_of_every_start(template, text):
    t = L.Template("t", " ".join(map(str, template)))
    words = [str(w) for w in text]
    got = t.find(words, [k for k, w in enumerate(words) if w in t.known])
    assert (got[3] if got else 0) == brute_places(words, t.words)
    assert got is None or got[0] >= 0.8 and words[got[1]] in t.known and words[got[2]] in t.known


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 4), st.sampled_from([3, 20, 200]), st.sampled_from([0, 10, 10**6]))
def test_suffix_order_and_prefixes(data_, times, cap, budget):
    body = bytes(1 + b % 4 for b in data_) * times
    text = np.frombuffer(body + b"\0", np.uint8)
    out = [x for p, c in induced.suffixes(text, cap, budget) for x in zip(p.tolist(), c.tolist())]
    assert sorted(p for p, _ in out) == list(range(len(body)))
    full = bytes(text)
    for (a, _), (b, c) in zip(out, out[1:]):
        x, y = full[a:a + cap], full[b:b + cap]
        assert x >= y and c == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def removed(texts, length):
    count = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_runs": 0}, {"sort_bytes": 500, "budget": 50}])
def test_repeats_of_odd_rows(spark, tmp_path, options):
    docs = data.odd_docs(spark, tmp_path)
    rows = docs.collect()
    want = removed([(r["text"] or "").encode() for r in rows if len(r["text"] or "") < 100_000], 200)
    got = X.removal_digest(docs, **options).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r)[1:] for r in got if r["n_bytes"] < 100_000) == sorted(want)
    assert [r["n_removed"] for r in got if r["n_bytes"] == 200_000] == [200_000]  # one letter throughout


def test_repeats_of_short_strings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 40)
    rng = random.Random(2)
    base = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(6)]
    texts = [base[rng.randrange(6)][:rng.randrange(60)] + base[rng.randrange(6)] + rng.choice("xyz") for _ in range(60)]
    docs = data.write(spark, tmp_path / "t.parquet", list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in X.removal_digest(docs, length=12, gram=4, sort_bytes=2000).collect()}
    assert [got[i] for i in range(60)] == removed([t.encode() for t in texts], 12)
    out = {r["doc_id"]: r["text"] for r in X.remove_repeats(docs, length=12, gram=4).collect()}
    assert all(len(out[i]) == got[i][0] - got[i][1] for i in range(60))


def test_repeats_keep_columns_and_empty_tables(spark, tmp_path):
    docs = data.odd_docs(spark, tmp_path)
    out = X.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert X.removal_digest(data.no_docs(spark, tmp_path / "none")).count() == 0
