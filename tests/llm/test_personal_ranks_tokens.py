"""Personal data, importance resampling and token alignment against brute
force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from salarium.llm import importance as I
from salarium.llm import pii as P
from salarium.llm import token_align as A
from tests.conftest import SF001
from tests.llm import data


def texts_of(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_hand(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


@pytest.fixture(scope="module")
def model(spark):
    return P.train(spark.read.parquet(f"{SF001}/documents.parquet"))


ODD = ["a@b.c.d@e.f x@y.z", "a@b.c+d@e.f", "..@..", "a@b", "é.x@y.zé", "1.2.3.4.5.6.7.8", "0255.1.2.003 256.1.1.1", "1.2.3", "9" * 40 + ".1.1.1",
       "4111 1111-1111 1111", "4111 1111  1111 1111", "4111111111111111 4111111111111111", "+1 (132) 555-1352.", "+1", "+1--2", "+12", "+123 45678",
       "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "😀 +1 (132) 555-1352 a@b.cd", "a@b.c" + ".d" * 20_000, "1." * 30_000, "1 " * 30_000, "a" * 3000,
       "a@b.c " * 4000, "+" * 50_000, "4111-1111-1111-1111 " * 2000, "1:2:" * 20_000, "ab at cd dot " * 3000]


def test_base_spans_equal_the_patterns(spark, tmp_path, model):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "@", ".", "1", "25", "+", " ", "-", "(", "b.c", "4111111111111111", "é", "255."]) for _ in range(rng.randrange(1, 60)))
            for _ in range(1500)]
    docs = data.write(spark, tmp_path / "d", list(enumerate(ODD + made)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in P.digest(P.find_personal_data(docs, model)).collect()}
    for i, text in enumerate(ODD + made):
        want = base_by_hand(text)
        assert [found[i][f"n_{k}"] for k in P.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in P.KINDS], text[:80]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        spans = [s.split(":") for s in found[i]["spans"].split(",") if s]
        assert set(want) <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), int(s[1]), int(s[2])))
        added = sorted((int(s[1]), int(s[2])) for s in spans if ":".join(s) not in want)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))
        base = [tuple(map(int, w.split(":")[1:])) for w in want]
        if len(base) * len(added) < 10_000:
            assert not any(a < d and c < b for a, b in base for c, d in added), text[:80]


def test_long_runs_take_linear_time(spark, tmp_path, model):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1 " * 300_000, "a." * 300_000 + "@", "+" * 500_000, "1.1" * 300_000, "a@" * 300_000, "1:" * 300_000]
    docs = data.write(spark, tmp_path / "d", list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    assert P.digest(P.find_personal_data(docs, model)).count() == len(texts)
    assert sum(r["n_ip"] for r in P.digest(P.find_personal_data(docs, model)).collect()) == 75_000  # four of 300,001 numbers each
    assert time.time() - began < 60


def test_boosted_trees_find_other_spellings(spark, tmp_path, model):
    there = {"mail me: jane.doe (at) posteo (dot) de now": "jane.doe (at) posteo (dot) de", "card 4111.1111.1111.1111 ok": "4111.1111.1111.1111",
             "call (030) 123-4567 today": "(030) 123-4567", "host fe80::1ff:fe23:4567:890a up": "fe80::1ff:fe23:4567:890a",
             "visa 3782 822463 10005": "3782 822463 10005", "tel 030/1234567": "030/1234567"}
    none = ["on 2024-03-15 at noon", "at 12:30:45 sharp", "isbn 978-3-16-148410-0", "order 123456789", "meet at ten.", "3 @ 2.50", "mac 00:1a:2b:3c:4d:5e",
            "version 10.2.33", "4111111111111112", "years 1998 1999 2000", "id 123456789012"]
    docs = data.write(spark, tmp_path / "d", list(enumerate([*there, *none])), "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in P.find_personal_data(docs, model).collect()}
    for i, (text, span) in enumerate(there.items()):
        assert [text[s["start"]:s["end"]] for s in got[i]] == [span], text
    for i, text in enumerate(none, len(there)):
        assert got[i] == [], text


def test_trees_score_alike_in_sql_and_by_hand(spark, model):
    rows = P.proposals(P.drawn(spark)).select(F.explode(F.expr("flatten(flatten(runs))")).alias("c"))
    rows = rows.select(F.expr(P.features(f"named_struct('p', {model.probability()}, 'f', f)")).alias("x")).limit(500).collect()
    for r in rows:
        x = [r["x"]["f"][k] for k in P.FEATURES]
        total = model.first + sum(P.tree_value(t, x) for t in model.trees)
        assert math.isclose(r["x"]["p"], 1 / (1 + math.exp(-(model.a * total + model.b))), rel_tol=1e-9)


def test_held_out_quality_of_drawn_lines(spark, model):
    lines = P.proposals(P.drawn(spark)).select("label", "kind", F.explode(F.expr("flatten(flatten(runs))")).alias("c")).where("c.kind = kind")
    judged = F.expr(P.features(model.probability()))
    lines = lines.where("pmod(xxhash64(c.body), 4) = 0").select("kind", "label", (judged >= F.expr(f"get(array({','.join(map(str, model.least))}), kind)")).alias("hit"))
    counts = Counter((r["kind"], r["label"], r["hit"]) for r in lines.collect())
    for kind in range(4):
        right, missed, wrong, kept = (counts[kind, y, h] for y, h in ((1, True), (1, False), (0, True), (0, False)))
        assert right / (right + missed) > 0.8, (kind, right, missed)
        assert wrong / (wrong + kept) < 0.05, (kind, wrong, kept)


def test_personal_data_of_odd_rows(spark, tmp_path, model):
    docs = data.odd_docs(spark, tmp_path)
    rows = P.digest(P.find_personal_data(docs, model)).collect()
    assert len(rows) == docs.count()
    empty = data.no_docs(spark, tmp_path / "none")
    assert P.digest(P.find_personal_data(empty, P.train(empty))).collect() == []


# ---- importance resampling


def ranks_by_hand(docs, target, share, least, ngram, buckets=I.BUCKETS, seed=I.SEED):
    def found(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(), Counter()
    each = [(d, *found(x)) for d, x in docs]
    for _, _, f in each:
        s.update(f)
    for x in target:
        t.update(found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for d, n, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[:share * len(fit) // 100]):
        r[4] = i + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("share,least,ngram", [(10, 20, 1), (100, 0, 2), (0, 5, 1), (35, 1, 3)])
def test_ranks_of_odd_rows(spark, tmp_path, share, least, ngram):
    docs = data.odd_docs(spark, tmp_path)
    target = spark.createDataFrame([("alpha1 beta2 gamma",), (None,), ("",)], "text string")
    got = I.importance_ranks(docs, target, share_percent=share, least_words=least, ngram=ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == ranks_by_hand(texts_of(docs.collect()), ["alpha1 beta2 gamma", None, ""], share, least, ngram)


def test_radix_ranks_equal_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(-2 ** 63, 2 ** 63), rng.randrange(50)]), rng.choice([rng.randrange(-2 ** 40, 2 ** 40), rng.randrange(4)]), rng.randrange(3))
            for _ in range(3000)]
    rows += [(7, 2, 1)] * 9000  # one key holds most rows
    got = I.radix_ranks(spark.createDataFrame(rows, "doc_id long, score long, other int")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["rank"])] == want
    assert I.radix_ranks(spark.createDataFrame([], "doc_id long, score long")).collect() == []


def test_resampled_rows_are_the_drawn_ones(spark, tmp_path):
    docs = data.odd_docs(spark, tmp_path)
    target = spark.createDataFrame([("alpha1 beta2",)], "text string")
    out = I.resample(docs, target, share_percent=40, least_words=2)
    assert out.columns == docs.columns
    ranks = I.importance_ranks(docs, target, share_percent=40, least_words=2).where("rank IS NOT NULL").collect()
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in ranks}
    assert I.resample(docs, target, share_percent=0).count() == 0
    assert I.resample(data.no_docs(spark, tmp_path / "none"), target).count() == 0


# ---- token alignment


@pytest.fixture(scope="module")
def tokenizers_by_hand():
    a = Tokenizer.from_file(f"{A.FOLDER}/{A.FILE_A}")
    a.encode_special_tokens = True
    letters = A.byte_letters()
    pair = A.pair_of(*A.load())
    piece = lambda i: pair.b.id_to_piece(i)
    byte_b = lambda i: bytes([int(piece(i)[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece(i)) else piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i)),
            lambda t: pair.b.encode(t), byte_b)


def alignment_by_hand(docs, tools):
    enc_a, byte_a, enc_b, byte_b = tools
    count, done = Counter(), {}
    each = []
    for d, text in docs:
        if text not in done:
            a, b = (enc_a(text), enc_b(text)) if text else ([], [])
            whole = (" " + (text or "")).encode()
            if b"".join(map(byte_a, a)) != whole or b"".join(map(byte_b, b)) != whole:
                a, b = [], []
            ends = [list(np.cumsum([len(f(i)) for i in ids])) for ids, f in ((a, byte_a), (b, byte_b))]
            at_a, at_b = dict(zip(ends[0], a)), dict(zip(ends[1], b))
            links = [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]
            groups, i, j = [], 0, 0
            for e in sorted(set(ends[0]) & set(ends[1])):
                x, y = i, j
                while ends[0][i] < e:
                    i += 1
                while ends[1][j] < e:
                    j += 1
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            done[text] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        each.append((d, *done[text]))
        count.update(done[text][3])
    best = {}
    for (a, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(repr((d, na, nb, g, len(li), sum(count[x] == best[x[1]] for x in li), sum(count[x] for x in li), h)) for d, na, nb, g, li, h in each)


def same_alignment(got, docs, tools):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == alignment_by_hand(docs, tools)


def test_alignment_of_odd_rows(spark, tmp_path, tokenizers_by_hand):
    docs = data.odd_docs(spark, tmp_path)
    same_alignment(A.alignment(docs), texts_of(docs.collect()), tokenizers_by_hand)
    assert A.alignment(data.no_docs(spark, tmp_path / "none")).collect() == []


def test_alignment_of_documents(spark, tokenizers_by_hand):
    rows = pq.read_table(f"{SF001}/documents.parquet").to_pylist()
    same_alignment(E.queries()["op13_token_alignment"](spark, SF001), texts_of(rows), tokenizers_by_hand)


def test_both_engines_cut_alike(spark, tmp_path, tokenizers_by_hand):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "é", "\n", "1", "<", "ing", "the", "\t", "日", "!", "'s", "\x1c", "\xa0", "　", "<|endoftext|>", "<s>", "👍🏽", "\x00", "é",
             "▁", "ﬁ", "<0x41>", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    docs = data.write(spark, tmp_path / "d", list(enumerate(texts)), "doc_id long, text string")
    same_alignment(A.alignment(docs), list(enumerate(texts)), tokenizers_by_hand)
