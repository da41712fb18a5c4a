"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit substitutions), the
lexicon is matched by one Aho-Corasick automaton, hits inside exception
phrases do not count, and the sum of weights is normalised by length.  A
logistic curve over the sum and its share of the words gives the score.

The lexicon is learned from labelled documents: whole words and word
beginnings whose document frequency differs between the classes beyond
chance, weighted by the log ratio of their frequencies; a base list covers
what the labels do not show.  Two-word phrases around lexicon words that
are common in clean documents become exceptions.  The classifier is fitted
on at most ``TRAIN_ROWS`` labelled documents, of the smallest id hash; the
lexicon has at most ``LEXICON`` entries and so a bounded broadcast.

Defined results: null and empty texts have no hits and get the score of a
text without hits; labels other than 0 and 1, null labels and null label
ids are no evidence; a repeated label counts as toxic if one says so; of
documents with one id the smallest text is trained on; without any usable
label the base list scores with fixed coefficients; rows, repeated ones
too, are scored one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.llm.common import keep_rows, ref
from salarium.session import materialize

TRAIN_ROWS = 8000
LEXICON = 2000
THRESHOLD = 0.3
#: Log ratio of frequencies from which a word or a word beginning enters.
LEAST_WORD, LEAST_STEM = 2.0, 2.0
#: Lengths of the word beginnings that may enter the lexicon.
STEMS = range(4, 9)

# Common abuse words, lookalike letters, digit substitutions
# and harmless phrases around abuse words.
BASE = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "filthy", "idiot", "imbecile", "loser",
        "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
HARMLESS = ("circus clown", "class clown", "clown fish", "dumb bell", "guinea pig", "pig farm", "pond scum", "trash bin",
            "trash can", "trash collection")
MEASURES = ("total", "share", "words")
BASE_WEIGHT = 4.0
BASE_COEFFICIENTS = (-4.0, 2.0, 0.5, 0.0)


class Folds(dict):
    """Plain lower-case letters for every code point that is a form of ASCII
    ones (accents, full width, mathematical, circled, ...) or looks like one;
    others stay."""

    def __init__(self) -> None:
        super().__init__({c: None for c in [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]})
        self.update({ord(k): v for k, v in LOOKALIKES.items()})

    def __missing__(self, c: int) -> str | int:
        plain = unicodedata.normalize("NFKD", chr(c))
        plain = "".join(x for x in plain if not unicodedata.combining(x)).lower()
        value = self[c] = plain if c > 127 and plain.isascii() else c
        return value


class Breaks(dict):
    """A space for every code point but letters and their marks."""

    def __missing__(self, c: int) -> str | int:
        value = self[c] = c if unicodedata.category(chr(c))[0] in "LM" else " "
        return value


_FOLD = Folds()
_BREAK = Breaks()
_SUBSTITUTE = re.compile(r"[013457@$!8]{1,2}(?=[a-z])")


def _letter(m: re.Match) -> str:
    at, text = m.start(), m.string
    inside = at > 0 and text[at - 1].isalpha()
    leads = len(m[0]) == 1 and (at == 0 or text[at - 1].isspace()) and text[m.end() + 1:m.end() + 2].isalpha()
    return "".join(DIGITS[c] for c in m[0]) if inside or leads else m[0]


def folded(text: str) -> str:
    """Words in plain lower-case letters, one space around each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _SUBSTITUTE.sub(_letter, text)
    return f" {' '.join(text.translate(_BREAK).split())} "


_SIGN = re.compile(r"[013457@$!8]")
_TOKEN = re.compile(r"[a-z013457@$!8]+")


def disguised(a: ahocorasick.Automaton, text: str) -> dict[str, float]:
    """Words (with their weights) of tokens of letters and substitution signs
    that hit only with all signs folded; signs at the ends fold or go."""
    out: dict[str, float] = {}
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if not len(a) or not _SIGN.search(text):
        return out
    tokens = list(_TOKEN.finditer(text))
    for i, m in enumerate(tokens):
        token = m[0]
        if token.isalpha() or not any(c.isalpha() for c in token):
            continue
        near = [tokens[k][0] if 0 <= k < len(tokens) else "" for k in (i - 1, i + 1)]
        before, after = (folded(t).split() for t in near)
        plain = folded(token)
        if hits(a, plain):
            continue
        left, right = token.lstrip("@$!"), token.rstrip("@$!")
        for form in dict.fromkeys((token, left, right, left.rstrip("@$!"))):
            word = "".join(DIGITS.get(c, c) for c in form)
            if f" {word} " == plain:
                continue
            lead = f" {before[-1]} " if before else " "
            found = hits(a, f"{lead}{word} {after[0]} " if after else f"{lead}{word} ")
            if len(lead) in found:
                out[word] = max(out.get(word, 0.0), found[len(lead)])
                break
    return out


@dataclass
class Model:
    """Lexicon terms (with a leading space, whole words with one behind
    too) and weights, exception phrases, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...] = BASE_COEFFICIENTS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0))
        if len(a):
            a.make_automaton()
        return a


def hits(a: ahocorasick.Automaton, text: str) -> dict[int, float]:
    """Weight of the best term at each word start outside exceptions."""
    best: dict[int, float] = {}
    if not len(a):
        return best
    excused = []
    for end, (n, weight) in a.iter(text):
        start = end - n + 2
        if weight:
            best[start] = max(best.get(start, 0.0), weight)
        else:
            excused.append((start, end))
    return {s: w for s, w in best.items() if not any(x <= s <= y for x, y in excused)} if excused else best


def measures(a: ahocorasick.Automaton, text: str, hidden: dict[str, float] | None = None) -> tuple[float, float, float]:
    """Sum of weights over different words, the share of all hits in the
    words, and the number of different words, all damped; ``hidden`` are
    the disguised words."""
    found = hits(a, text)
    words = max(1, text.count(" ") - 1)
    distinct = {text[s:text.find(" ", s)]: w for s, w in found.items()}
    distinct |= hidden or {}
    total = sum(distinct.values())
    return float(np.log1p(total)), float(np.log1p(100.0 * (sum(found.values()) + sum((hidden or {}).values())) / words)), float(np.log1p(len(distinct)))


def crc_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str, text_col: str,
                  label_col: str, limit: int) -> DataFrame:
    """At most ``limit`` (text, label) rows that are not held out."""
    known = (labels.select(ref(labels, id_col).alias("id"), ref(labels, label_col).alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")))
    known = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(ref(docs, id_col).alias("id"), ref(docs, text_col).cast("string").alias("text"))
    joined = rows.join(F.broadcast(known), "id")  # at most ``limit`` rows
    one = joined.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("signature", pa.array([signature(t.as_py() or "") for t in b.column("text")], pa.string()))

    # copies of one text are one piece of evidence
    signed = one.select("text", F.col("label").cast("int").alias("label")).mapInArrow(sign, "text string, label int, signature string")
    return materialize(signed.groupBy("signature").agg(F.min("text").alias("text"), F.max("label").alias("label")).drop("signature"))


def signature(text: str) -> str:
    """The word triple of smallest hash: near copies mostly share it."""
    words = folded(text).split()
    triples = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return min(triples, key=lambda t: (xxhash.xxh64_intdigest(t), t))


def emit(train: DataFrame, terms_of: Callable[[str], set[str]], out: str) -> DataFrame:
    """(term, toxic, clean): document frequencies in the two classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label")):
                terms = list(terms_of(folded(text.as_py() or "")))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label.as_py()] * len(terms), pa.int32())],
                                                 [out, "label"])

    return (train.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, f"{out} string, label int")
            .groupBy(out).agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")))


def whole_words(text: str) -> set[str]:
    return {f" {w} " for w in text.split()}


def stems(text: str, explained: set[str]) -> set[str]:
    """Beginnings of the words that are no lexicon entry themselves."""
    return {f" {w[:k]}" for w in set(text.split()) if f" {w} " not in explained for k in STEMS if len(w) > k}


def learn(train: DataFrame) -> Model:
    """Lexicon, exceptions and curve from (text, label) rows."""
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = {f" {w} ": BASE_WEIGHT for w in BASE}
    harmless = tuple(f" {p} " for p in HARMLESS)
    if not toxic or not clean:
        return Model(base, harmless)
    p, n = F.col("toxic"), F.col("clean")

    def part(count: Column, size: int) -> Column:
        share = (p + n) * size / (toxic + clean)
        return F.when(count > 0, count * F.log(count / share)).otherwise(0.0)

    def telling(counts: DataFrame, limit: int, least: float, margin: float) -> dict[str, float]:
        # chance exceeds this in less than one of the terms that are frequent enough to be judged
        chance = 2 * F.log(F.lit(float(max(2, counts.where(p + n >= 4).count())))) + margin
        rows = (counts.withColumn("gain", 2 * (part(p, toxic) + part(n, clean))).withColumn("weight", weight)
                .where((F.col("gain") > chance) & (F.col("weight") > least))
                .orderBy(F.col("gain").desc(), "term").limit(limit).collect())
        return {r["term"]: r["weight"] for r in rows}

    weight = F.log((p + 0.5) / (toxic + 1.0)) - F.log((n + 0.5) / (clean + 1.0))
    words = materialize(emit(train, whole_words, "term"))
    found = telling(words, LEXICON // 2, LEAST_WORD, 2.0)
    seen = words.where(F.col("term").isin(list(base)) & (p + n >= 5)).withColumn("weight", weight).collect()
    weights = base | {r["term"]: r["weight"] for r in seen} | found
    explained = {t for t, w in weights.items() if w > 0}
    weights |= telling(materialize(emit(train, lambda text: stems(text, explained), "term")), LEXICON // 2, LEAST_STEM, 6.0)
    model = Model({t: w for t, w in weights.items() if w > 0}, harmless)

    def phrases(text: str) -> set[str]:
        a, out = model.automaton(), set()
        for s in hits(a, text):
            end = text.find(" ", s)
            before, after = text.rfind(" ", 0, max(0, s - 2)), text.find(" ", end + 1)
            if s >= 2:
                out.add(f" {text[before + 1:end]} ")
            if after > 0:
                out.add(f" {text[s:after]} ")
        return out

    common = (emit(train, phrases, "phrase").where((n >= 3) & (n * toxic > 4 * p * clean))
              .orderBy(n.desc(), "phrase").limit(LEXICON).collect())
    model.exceptions = tuple(sorted({*harmless, *(r["phrase"] for r in common)}))
    data = apply_model(train, model, "text", ["label"], scores=False).collect()  # at most TRAIN_ROWS rows of numbers
    model.coefficients = fit(np.array([[r[c] for c in MEASURES] for r in data]), np.array([float(r["label"]) for r in data]))
    return model


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    b[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def score_of(model: Model, m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.coefficients[0] + m @ np.array(model.coefficients[1:]), -30, 30)))


def measured(a: ahocorasick.Automaton, texts: pa.Array) -> np.ndarray:
    plain = [t.as_py() or "" for t in texts]
    return np.array([measures(a, folded(t), disguised(a, t)) for t in plain]).reshape(-1, len(MEASURES))


def apply_model(rows: DataFrame, model: Model, text_col: str, keep: list[str], scores: bool = True) -> DataFrame:
    """The ``keep`` columns of ``rows`` with ``score``, or with the
    measures behind it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most LEXICON terms and as many phrases
    names = ["score"] if scores else list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        a = model.automaton()
        for batch in batches:
            m = measured(a, batch.column(0))
            values = [score_of(model, m)] if scores else list(m.T)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, values)], [*keep, *names])

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), *(f"{n} double" for n in names)])
    return rows.select(ref(rows, text_col).cast("string").alias("text"), *[ref(rows, k) for k in keep]).mapInArrow(run, schema)


def held_out_rows(doc_id: Column) -> Column:
    """Rows that never train: remainder 2 of the id's CRC."""
    return crc_of(doc_id) == 2


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                limit: int = TRAIN_ROWS) -> Model:
    return learn(training_rows(docs, labels, held_out_rows, id_col, text_col, label_col, limit))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).alias("text"))
    scored = apply_model(rows, model, "text", ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pa.Array) -> list[bool]:
        model = shared.value
        return (score_of(model, measured(model.automaton(), texts)) < THRESHOLD).tolist()

    return keep_rows(docs, text_col, clean)
