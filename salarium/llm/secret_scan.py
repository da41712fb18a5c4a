"""Secret scan: fixed patterns plus character Markov models.

Two first-order models of characters, one of random strings and one of
ordinary words and identifiers, are compared by the log-likelihood ratio of
every long token; a token that is far likelier random becomes a span.  The
models are counted from labelled samples: strings that the fixed patterns
find and strings drawn from a hash for the random class, the other tokens of
at most ``TRAIN_DOCS`` documents for the ordinary class.  DataFrame
functions only; the driver holds the counts of character pairs alone.

Spans are in code points, the end exclusive.  Defined results: null and
empty texts have no spans; without any document the models know the drawn
strings only, and nothing is scored; repeated rows and rows of null id each
keep a result row.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.llm.common import ref
from salarium.session import materialize

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"

TRAIN_DOCS = 2000
#: Strings drawn for the random class, in each of three alphabets.
DRAWN = 2000
#: Log-likelihood ratio from which a token counts as random.
LEAST_RATIO = 10.0
FIRST, WIDTH = 43, 80  # codes of the characters '+' to 'z'


def literal(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, 0)"


def starts(text: str, found: str, pattern: str) -> str:
    """SQL: first code points of the matches, from the lengths of the pieces
    between them; summed in blocks, so long lists stay cheap."""
    step = "(s, x) -> named_struct('at', s.at + x.gap + x.n, 'out', array_append(s.out, s.at + x.gap))"
    pairs = (f"zip_with(slice(split({text}, {literal(pattern)}, -1), 1, size({found})), {found}, "
             "(p, m) -> named_struct('gap', char_length(p), 'n', char_length(m)))")
    zero = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    block = f"aggregate(slice(l, 256 * b + 1, 256), named_struct('at', s.at, 'out', cast(array() as array<int>)), {step})"
    blocks = f"sequence(0, (size({found}) - 1) div 256)"
    # the list is bound once as l, and each block's result once as r
    return (f"if(size({found}) = 0, cast(array() as array<int>), "
            f"transform(array({pairs}), l -> aggregate({blocks}, {zero}, (s, b) -> "
            f"transform(array({block}), r -> named_struct('at', r.at, 'out', concat(s.out, r.out)))[0]).out)[0])")


def spans(text: str, found: str, pattern: str, kind: int) -> str:
    """SQL: (start, kind, end, body) of every match."""
    return (f"zip_with({starts(text, found, pattern)}, {found}, (a, m) -> "
            f"named_struct('start', a, 'kind', {kind}, 'end', a + char_length(m), 'body', m))")


def ratio(token: str) -> str:
    """SQL: log-likelihood ratio of a token by the pair weights ``w``."""
    codes = f"transform(split({token}, ''), c -> ascii(c) - {FIRST})"
    pairs = f"zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> get(w, a * {WIDTH} + b))"
    return f"transform(array({codes}), v -> aggregate({pairs}, 0D, (s, x) -> s + x))[0]"


def sample(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct texts, those of the smallest hashes."""
    rows = docs.select(ref(docs, text_col).cast("string").alias("text")).where("length(text) > 0")
    hashes = rows.select(F.xxhash64("text").alias("h")).distinct()
    few = hashes.orderBy("h").limit(limit)  # at most ``limit`` longs
    chosen = rows.join(F.broadcast(few), F.xxhash64("text") == F.col("h"), "left_semi")
    return chosen.groupBy("text").agg(F.lit(1).alias("one")).select("text")


def drawn(df: DataFrame) -> DataFrame:
    """Random strings from a hash: base64, hexadecimal and capital ones."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    kinds = [F.substring(F.base64(F.unhex(digest)), 1, 32), F.substring(digest, 1, 32),
             F.upper(F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 32), "[+/=]", "Q"))]
    return df.sparkSession.range(DRAWN).select(F.explode(F.array(*kinds)).alias("token"))


def pair_counts(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters; at most WIDTH squared rows."""
    pairs = tokens.select(F.explode(F.expr(
        "transform(array(split(token, '')), v -> zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), "
        "(a, b) -> named_struct('a', ascii(a), 'b', ascii(b))))[0]")).alias("p"))
    return {(r["a"], r["b"]): r["n"] for r in pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}


def train(docs: DataFrame, text_col: str = "text", limit: int = TRAIN_DOCS) -> list[float] | None:
    """Weights of character pairs: log P(b | a) as random less as ordinary."""
    texts = materialize(sample(docs, text_col, limit))
    secrets = texts.select(F.explode(F.expr(
        f"concat(transform({matches('text', ASSIGN)}, m -> regexp_extract(m, {literal(ASSIGN)}, 2)), "
        f"{matches('text', ACCESS)}, {matches('text', HEX)})")).alias("token")).where("length(token) > 11")
    rest = texts
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = rest.select(F.regexp_replace("text", pattern, " ").alias("text"))
    words = rest.select(F.explode(F.expr(matches("text", ORDINARY))).alias("token"))
    random, ordinary = pair_counts(secrets.unionByName(drawn(docs))), pair_counts(words)
    if not ordinary:
        return None

    def logs(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
        total = {a: sum(n for (x, _), n in counts.items() if x == a) for a in range(FIRST, FIRST + WIDTH)}
        return {(a, b): math.log((counts.get((a, b), 0) + 0.5) / (total[a] + 0.5 * 66))
                for a in range(FIRST, FIRST + WIDTH) for b in range(FIRST, FIRST + WIDTH)}

    r, o = logs(random), logs(ordinary)
    return [round(r[a, b] - o[a, b], 6) for a in range(FIRST, FIRST + WIDTH) for b in range(FIRST, FIRST + WIDTH)]


def find_secrets(docs: DataFrame, weights: list[float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, random): arrays of spans (start, kind, end, body) of
    the patterns and of the models, each sorted by start, then kind."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), F.coalesce(ref(docs, text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.expr(matches("text", ASSIGN)).alias("m0"), F.expr(matches("text", ACCESS)).alias("m1"),
                       F.expr(matches("text", HEX)).alias("m2"), F.expr(matches("text", TOKEN)).alias("m3"))
    assigned = f"char_length(regexp_extract(x.body, {literal(ASSIGN)}, 2)) >= {LEAST_ASSIGNED}"
    base = (f"array_sort(concat(filter({spans('text', 'm0', ASSIGN, 0)}, x -> {assigned}), "
            f"{spans('text', 'm1', ACCESS, 1)}, {spans('text', 'm2', HEX, 2)}))")
    kind = "array<struct<start:int,kind:int,end:int,body:string>>"
    if weights is None:
        return rows.select("doc_id", F.expr(base).alias("base"), F.expr(f"cast(array() as {kind})").alias("random"))
    rows = rows.withColumn("w", F.from_json(F.lit(json.dumps(weights)), "array<double>"))
    likely = f"exists(m3, t -> {ratio('t')} >= {LEAST_RATIO})"  # positions only where a token passes
    random = (f"if({likely}, filter({spans('text', 'm3', TOKEN, 3)}, t -> {ratio('t.body')} >= {LEAST_RATIO}), "
              f"cast(array() as {kind}))")
    rows = rows.select("doc_id", F.expr(base).alias("base"), F.expr(random).alias("tokens"))
    return rows.select("doc_id", "base", F.expr(
        "filter(tokens, t -> NOT exists(base, b -> b.start < t.end AND t.start < b.end))").alias("random"))


def names(spans_col: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans_col}, x -> concat(array({kinds})[x.kind], ':', x.start, ':', x.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, hash of the base spans and all spans."""

    def count(kind: int) -> Column:
        return F.expr(f"cast(size(filter(base, x -> x.kind = {kind})) as bigint)")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(F.expr(names("base")), 256).alias("base_sha256"),
                        F.expr(names("array_sort(concat(base, random))")).alias("spans"))
