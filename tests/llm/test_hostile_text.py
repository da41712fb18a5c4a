"""Spellings that hide words, teasers that look like articles, pages that
never close."""

import time
import tracemalloc

import pytest

from salarium.llm import toxicity as X
from salarium.llm.html_extract import extract
from salarium.llm.page_tree import parse
from tests.conftest import SF01
from tests.llm import data


@pytest.mark.parametrize("text", ["an “idiot” and", "«idiot»", "idiot…", "idiot—moron", "–idiot–", "the idiot’s", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "ⓘⓓⓘⓞⓣ", "ＩＤＩＯＴ", "ïdíôt", "‹idiot›", "idiot„", "•idiot•",
                                  "idi​ot", "1d10t", "іdіоt"])
def test_typographic_signs_break_words_and_letters_fold(text):
    model = X.Model({" idiot ": 1.0}, ())
    a = model.automaton()
    assert X.hits(a, X.folded(text)) or X.disguised(a, text), text


@pytest.mark.parametrize("text", ["idiotic’", "anidiot—", "id…iot", "idi ot"])
def test_parts_of_words_are_no_words(text):
    model = X.Model({" idiot ": 1.0}, ())
    a = model.automaton()
    assert not X.hits(a, X.folded(text)) and not X.disguised(a, text), text


def test_toxic_words_between_typographic_signs(spark, tmp_path):
    """Planted spellings of lexicon words are caught, clean texts with the
    same signs are not."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train_model(docs, labels)
    words = [w.strip() for w, _ in sorted(model.weights.items(), key=lambda x: (-x[1], x[0])) if w.strip().isascii() and w.startswith(" ") and w.endswith(" ")][:6]
    plain = [f"the {a} and the {b} of the {c}" for a, b, c in zip(words, words[1:], words[2:])]
    bold = {ord(c): chr(0x1D41A + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    spelled = [f for p in plain for f in (p, p.replace(" the ", " “the” «").replace(" of", "» … of"), "—".join(p.split()), p.translate(bold))]
    clean = ["“the” house — and the «garden» of … the town", "the house’s “garden”"]
    rows = data.write(spark, tmp_path / "d", list(enumerate(spelled + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in X.toxicity(rows, model).collect()}
    for i in range(0, len(spelled), 4):
        assert all(abs(got[i + k] - got[i]) < 0.35 and got[i + k] >= 0.3 for k in range(4)), spelled[i]
    assert all(got[len(spelled) + k] < 0.3 for k in range(len(clean)))


def test_constant_teasers_do_not_replace_the_text(spark, tmp_path):
    """Own text outside, two constant teasers inside article elements."""
    def page(i):
        return (f"<html><body><div class='cards'><article>Same teaser A</article><article>Same teaser B</article></div>"
                f"<div class='content'><p>Own text {' '.join(f'w{i}x{k}' for k in range(30))}</p></div></body></html>")
    rows = data.write(spark, tmp_path / "p", [(i, f"http://one.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(rows).collect()}
    assert all(f"w{i}x29" in got[i] and "teaser" not in got[i] for i in range(12))


def test_closed_empty_comments():
    for source in ("<p>a</p><!--><p>b</p>", "<p>a</p><!---><p>b</p>", "<p>a</p><!-- > --><p>b</p>"):
        assert " ".join(b.text for b in parse(source).blocks) == "a b"
    assert [b.text for b in parse("<p>a</p><!-- <p>b</p>").blocks] == ["a"]
    assert [b.text for b in parse("<p>a</p> 1 < 2 <!-- b").blocks] == ["a", "1 < 2"]


@pytest.mark.parametrize("source", ["<a " * 350_000, "<a x=\"" * 175_000, "<a x='" * 175_000 + ">", "<" * 1_000_000, "<div>" * 200_000, "<div class=ad>" * 70_000,
                                    "<b>" * 100_000 + "</i>" * 100_000 + "</b>" * 100_000, "<div>" * 70_000 + "</p>" * 70_000 + "<p>" * 70_000,
                                    "<svg/>" * 160_000, "<!--" * 250_000, "<a " * 300_000 + "<!--", "&" * 1_000_000, "<li>" * 250_000],
                         ids=lambda s: s[:8] + s[-4:])
def test_a_megabyte_of_broken_markup(source):
    tracemalloc.start()
    began = time.process_time()
    parse(source)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 90 and peak < 400e6, (took, peak)  # a traced run is several times slower; a quadratic one takes hours
