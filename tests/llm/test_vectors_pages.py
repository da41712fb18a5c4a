"""Nearest neighbours, page extraction and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from salarium.llm import ann as A
from salarium.llm import html_extract as W
from salarium.llm.page_tree import parse
from tests.conftest import SF001
from tests.llm import data


def brute(rows, every, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()
            and any(v)]
    out = set()
    for n, (i, v) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)), j) for m, (j, w) in enumerate(good) if m != n)[:k]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(20)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, []),
             (206, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in A.nearest(table, lambda c: F.pmod(c, F.lit(5)) == 0).collect()}
    assert got == brute([r for r in rows if r[0] != 206], 5)


def test_neighbours_among_rescaled_copies(spark):
    """Different vectors of one cosine, more than are wanted, in one slice."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=6)
    rows = [(1000 - i, (base * 2.0 ** (i - 25)).tolist()) for i in range(50)]
    rows += [(i, rng.normal(size=6).tolist()) for i in range(20)] + [(500 + i, [float(x == i % 6) for x in range(6)]) for i in range(24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in A.nearest(table, lambda c: F.pmod(c, F.lit(5)) == 0).collect()}
    assert got == brute(rows, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 1.0])], [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])]])
def test_few_vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in A.nearest(table, lambda c: F.pmod(c, F.lit(50)) == 0).collect()}
    assert got == brute(rows, 50)


def test_recall_in_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 40)
    monkeypatch.setattr(A, "LEAST_CANDIDATES", 100)
    table = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {(r["query_id"], r["vec_id"]) for r in A.nearest(table, lambda c: F.pmod(c, F.lit(20)) == 0).collect()}
    want = {(q, v) for q, _, v in brute(rows, 20)}
    assert len(got & want) >= 0.9 * len(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><main><article><h1>Ti&amp;tle</h1><p>First <b>bold</b>text&nbsp;&eacute; &#x41;
<p>Second<br>line<div class="ad">Buy</div><script>var x="</p><p>";</script><form><input><button>Go</button></form><!-- <p>no</p> -->
<p>a &lt; b & c</p><section id="comments"><p>Reader says</p></section></article></main><footer>&copy; X</footer></body></html>"""
TEXT = "Ti&tle First boldtext é A Second line a < b & c"


def test_article_of_a_page(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "odd url", ""), (4, "http://b.example", "plain <b>text"), (None, "http://a.example/x", PAGE),
            (5, "http://c.example", "<div class='x'>cut <p>off &am"), (6, "http://d.example", "<p>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in W.extract(pages).collect()), key=repr)
    want = [(1, TEXT), (2, ""), (3, ""), (4, "plain text"), (None, TEXT), (5, "cut off &am"), (6, "deep")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert W.extract(pages.limit(0)).count() == 0


ODD_MARKS = [
    "<body class='single has-sidebar'><nav>Menu</nav><p>The text of it</p></body>",
    "<body><nav>Menu</nav><div id='page' class='no-sidebar'><p>The text of it</p></div><footer>End</footer></body>",
    "<body><article class='post social'><p>The text of it</p></article><div class='related'><article>Teaser</article></div></body>",
    "<html class='no-widget'><body><form action='/'><nav>Menu</nav><main><p>The text of it</p></main><div>End</div></form></body></html>",
    "<body><form><div class='menu'>Menu</div><p>The text of it</p></form></body>",
    "<body><main><h1>The</h1><div class='with-sidebar'><p>text of it</p></div></main></body>",
    "<body style='visibility: hidden'><p>The text of it</p><div class=ad>Buy</div></body>",
    "<body><div class='has-sidebar'><article class='post social'><p>The text of it</p></article><p>Teaser</p></div></body>",
    "<body><article><p>The text of it</p><div id=comments><p>Reader says at more length</p></div></article></body>",
    "<body><article><p>The text of it</p></article><div id=comments><article class=comment-body>Reader says at much more length</article></div></body>",
]


@pytest.mark.parametrize("odd", ODD_MARKS)
def test_names_do_not_rule_out_the_page(odd):
    assert W.article(parse(odd), set()) == "The text of it"


def test_repeated_branches_of_a_site_go(spark):
    """Without telling names or article elements, by the site's tree alone."""
    rows = [(i, f"https://Site.example/{i}", f"<body><div class=upper><p>Same links here</p></div><div class=middle><p>Own text {i} of page {i * i}</p></div>"
                                             "<div class=lower><p>Same end</p></div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (W.BROADCAST_NODES, -1):
        got = {r["page_id"]: r["text"] for r in W.extract(pages, broadcast_nodes=limit).collect()}
        assert got == {i: f"Own text {i} of page {i * i}" for i in range(12)}


@pytest.mark.parametrize("changed", ["", "{}"])
def test_copies_of_a_page_count_once(spark, changed):
    """Most rows of the host are copies, or near copies, of one page."""
    def words(i):
        return " ".join(f"w{i}x{k * k % 97}y{k}" for k in range(300))

    def page(i, date):
        return (f"<body><div class=upper>Same links here</div><div class=middle><p>{words(i)}</p><p>more of {words(i + 1000)}</p></div>"
                f"<div class=date>Seen {date}</div><div class=lower>Same end</div></body>")

    rows = [(i, "https://site.example/x", page(i, i * 7)) for i in range(12)]
    rows += [(100 + i, "https://site.example/y", page(99, "99 " + changed.format(i))) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 72
    for i, _, html in rows:
        n = i if i < 100 else 99
        assert words(n) in got[i] and words(n + 1000) in got[i] and "Same" not in got[i]


def test_importance_is_entropy(spark):
    rows = [("h", f"<body><p>{'same' if i < 8 else i}</p></body>") for i in range(16)]
    tree = {r["node"]: r["importance"] for r in W.site_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    content = 1 - (8 * math.log(8) / 16) / math.log(16)
    assert abs(tree["/body/p"] - 0.9 * content) < 1e-12  # one presentation: no entropy


def test_parse_is_total():
    for odd in ("<", "<a", "<a href='x", "</", "<!--", "<!DOCTYPE", "<script>never closed", "<p></b></div>x", "a<b>c", "<a b=\"<p>\">t</a>"):
        parse(odd)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns or i == len(C.STAGES) - 1
        if name != "mixing":
            assert 0.5 * before < docs.count() <= before
        before = docs.count()
    assert C.run(spark, SF001).count() == before


def test_pipeline_of_odd_rows(spark, tmp_path):
    data.odd_docs(spark, tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() > 0
