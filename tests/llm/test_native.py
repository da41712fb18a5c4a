"""Mixing, sharding and secrets against SQL and brute force."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as E
from salarium.llm import mix as M
from salarium.llm import queries as Q
from salarium.llm import secret_scan as S
from salarium.llm import shard as H
from tests.conftest import SF001
from tests.llm import data


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in cur.fetchall())


def view(tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_registered_queries_match_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{SF001}/{name_}.parquet')")
    same(E.queries()[name](spark, SF001), con, E.oracle_sql()[name])


@pytest.mark.parametrize("limit", [0, 50, 3000, 1 << 40])
def test_shards_of_odd_rows(spark, tmp_path, limit):
    docs = data.odd_docs(spark, tmp_path)
    same(H.assign_shards(docs, limit=limit), view(tmp_path), Q.op1_sql(limit=limit))


def test_shards_fit_and_rows_stay(spark, tmp_path):
    docs = data.odd_docs(spark, tmp_path)
    out = H.shard_documents(docs, limit=4000)
    assert out.columns == [*docs.columns, "_shard"]  # the name was taken
    rows = out.collect()
    assert len(rows) == docs.count()
    size, count = {}, {}
    for r in rows:
        size[r["_shard"]] = size.get(r["_shard"], 0) + len((r["text"] or "").encode())
        count[r["_shard"]] = count.get(r["_shard"], 0) + 1
    assert all(size[s] <= 4000 or count[s] == 1 for s in size)
    assert not any(a != b and b.startswith(a) for a in size for b in size)


@pytest.mark.parametrize("seed", [0, 5])
def test_mix_of_odd_rows(spark, tmp_path, seed):
    docs = data.odd_docs(spark, tmp_path)
    mixed = M.mix_copies(docs, seed=seed)
    got = mixed.select("doc_id", "size", "source_size", "target", (mixed["copies"] * mixed["size"]).alias("taken"))
    same(got, view(tmp_path), Q.op2_sql(seed=seed))
    rows = M.mix(docs, seed=seed)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in mixed.collect())


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), (None, 3), ("e", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(sizes).collect()}
    assert got["a"] == 3 and got["e"] == 0 and got["b"] == 300  # at the cap
    assert got[None] == 9 and abs(sum(got.values()) - 1104) < 1e-9


def test_native_operators_on_an_empty_table(spark, tmp_path):
    docs = data.no_docs(spark, tmp_path)
    assert H.assign_shards(docs).count() == 0 and H.shard_documents(docs).count() == 0
    assert M.mix(docs).count() == 0 and M.mix_copies(docs).count() == 0
    weights = S.train(docs)
    assert weights is None and S.digest(S.find_secrets(docs, weights)).count() == 0


@pytest.mark.parametrize("op", [M.mix_copies, H.assign_shards])
def test_no_python_in_the_plan(spark, tmp_path, op):
    plan = op(data.odd_docs(spark, tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    rules = [(ASSIGN, lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
             (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m))


ODD_SECRETS = ["password: token: abcdefghijklmnopq", "é é secret=é AKIAAKIA1 " + "AKIA" + "Z" * 14, "ß token='" + "a" * 20 + "' deadbeefdeadbeefdead",
               "deadbeefdeadbeef " * 700, "API_KEY=" + "x" * 12 + " apikey :  'short'", "Passwd==" + "=" * 12, None, "",
               "key Zm9vYmFyMTIzNDU2Nzg5MHh5eg/+QkFR98sdf7sdf0sd9f", "some_function_name_identifier", "AKIA" + "1" * 13]


def test_secrets_against_patterns(spark, tmp_path):
    docs = data.odd_docs(spark, tmp_path)
    weights = S.train(spark.read.parquet(f"{SF001}/documents.parquet"))
    extra = spark.createDataFrame(list(enumerate(ODD_SECRETS)), "doc_id long, text string")
    for table in (docs, extra, spark.read.parquet(f"{SF001}/documents.parquet")):
        found = S.digest(S.find_secrets(table, weights))
        texts = sorted((r["text"] or "" for r in table.select("text").collect()))
        want = sorted(hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in base_spans(t)).encode()).hexdigest() for t in texts)
        assert sorted(r["base_sha256"] for r in found.collect()) == want


def test_markov_models_tell_random_from_ordinary(spark):
    weights = S.train(spark.read.parquet(f"{SF001}/documents.parquet"))
    docs = spark.createDataFrame(list(enumerate(ODD_SECRETS)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in S.digest(S.find_secrets(docs, weights)).collect()}
    assert spans[8].startswith("random:4:") and spans[9] == ""
