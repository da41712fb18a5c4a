"""Personal data: fixed patterns plus gradient boosting over candidates.

The patterns give the base spans.  High-recall generators propose further,
overlapping spans: any spelling of an address, any IPv6-like run, and every
long digit run as card and as phone number, whole and by its parts.  Boosted
trees judge each proposal by its format (digits, groups, separators, check
digit, leading sign) and its context (cue words before it, characters at its
sides).  A proposal goes into the result if its probability reaches its
kind's calibrated threshold, it is the best of its run, and it overlaps no
base span.

The trees are fitted on the driver from labelled proposals: lines drawn by
rule (``drawn``) and, from at most ``TRAIN_DOCS`` texts, proposals that a
pattern accepts or whose check it refuses; at most ``TRAIN_ROWS`` different
feature rows travel.  A quarter of them is held out: on it the scores are
calibrated and each kind gets the lowest threshold at which the share of
wrong selections stays within ``WRONG``.  Everything that reads the corpus is
SQL functions.

Spans are in code points, the end exclusive.  Defined results: null and empty
texts have no spans; an empty table gives no row; repeated rows and rows of
null id each keep a result row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.llm.common import ref
from salarium.llm.secret_scan import literal, matches, sample, spans
from salarium.session import materialize

# The kinds in order and their patterns.  Runs are possessive
# and start where the run starts (or the last match ends), which finds the
# same spans in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Generators.
AT = r"(?:@|＠|[(\[{]at[)\]}]|\x20at\x20)"
DOT = r"(?:\.|．|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
NAME = r"[\p{L}\p{N}._%+-]"
ADDRESS = rf"(?<!{NAME}){NAME}++\x20?{AT}\x20?[\p{{L}}\p{{N}}-]++(?:{DOT}[\p{{L}}\p{{N}}-]++)++"
COLONS = r"(?<![\p{L}\p{N}:])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,45}+"
DIGITS = r"(?<![\p{L}\p{N}])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"
PROPOSE = f"(?i){ADDRESS}|{COLONS}|{DIGITS}"
GROUP = r"[^\x20]{7,}+"

TRAIN_DOCS = 1000
TRAIN_ROWS = 20_000
#: Lines drawn for each template.
DRAWN = 150
#: Share of wrong selections that a threshold may allow on held-out rows.
WRONG = 0.02
TREES, DEPTH, RATE, LEAST_ROWS = 40, 3, 0.3, 8
CONTEXT = 24

CUES = {  # words that announce a kind, 5: words that announce another number
    1: "e-?mail|mailto|contact|write to|correo|courriel",
    2: "ip|ipv6|host|server|addr(?:ess)?|gateway|dns",
    3: "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte",
    4: "tel|phone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|whatsapp",
    5: "order|invoice|isbn|issn|ref|version|serial|ticket|article|page|id|no|nr|date|time|year",
}


def base_spans(text: str = "text") -> dict[str, str]:
    """SQL: the spans of each kind that pass its check."""
    found = {k: spans(text, f"m{i}", p, i) for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))}
    digits = "regexp_replace(x.body, '[^0-9]', '')"
    passes = {
        "ip": f"x.body rlike {literal('^' + PART + (r'[.]' + PART) * 3 + '$')}",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    return {k: f"filter({s}, x -> {passes[k]})" if k in passes else s for k, s in found.items()}


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, base): base spans by kind, then start."""
    rows = docs.select(ref(docs, id_col).alias("doc_id"), F.coalesce(ref(docs, text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[F.expr(matches("text", p)).alias(f"m{i}") for i, p in enumerate((EMAIL, IP, CARD, PHONE))])
    return rows.select("doc_id", "text", F.expr(f"concat({', '.join(base_spans().values())})").alias("base"))


def proposals(rows: DataFrame) -> DataFrame:
    """Adds ``runs``: for each generator match its spans, the whole one first,
    for each span its proposals, one a kind: structs (start, kind, end, body,
    before, after) with the context of the match."""
    rows = rows.withColumn("g", F.expr(matches("text", PROPOSE)))
    # pieces between matches are the context, so no text is cut twice
    pieces = f"split(text, {literal(PROPOSE)}, -1)"
    rows = rows.withColumn("runs", F.expr(f"""if(size(g) = 0, null, transform(array({pieces}), p -> zip_with(
        {spans('text', 'g', PROPOSE, 0)}, sequence(0, size(g) - 1), (x, i) -> named_struct(
          'start', x.start, 'end', x.end, 'body', x.body, 'before', lower(right(get(p, i), {CONTEXT})), 'after', left(get(p, i + 1), 1))))[0])"""))

    def one(start: str, end: str, body: str, kind: str) -> str:
        return (f"named_struct('start', {start}, 'kind', {kind}, 'end', {end}, 'body', {body}, 'before', r.before, 'after', r.after)")

    def numbers(start: str, end: str, body: str) -> str:
        """A digit run as each kind of number that its count of digits allows."""
        n = f"length(regexp_replace({body}, '[^0-9]', ''))"
        return f"filter(array({one(start, end, body, '2')}, {one(start, end, body, '3')}), c -> {n} BETWEEN if(c.kind = 2, 12, 7) AND if(c.kind = 2, 19, 15))"

    groups = spans("r.body", f"regexp_extract_all(r.body, {literal(GROUP)}, 0)", GROUP, 0)
    parts = f"transform({groups}, q -> {numbers('r.start + q.start', 'r.start + q.end', 'q.body')})"
    return rows.withColumn("runs", F.expr(f"""transform(runs, r -> CASE
        WHEN r.body rlike '^[0-9A-Fa-f:]+$' AND instr(r.body, ':') > 0 THEN array(array({one('r.start', 'r.end', 'r.body', '1')}))
        WHEN r.body rlike '^[+(]*[0-9][0-9 ()./-]*$' THEN concat(array({numbers('r.start', 'r.end', 'r.body')}), if(instr(r.body, ' ') > 0, {parts}, array()))
        ELSE array(array({one('r.start', 'r.end', 'r.body', '0')})) END)""")).drop("g")


def counted(sign: str, most: int) -> str:
    return f"least(length(c.body) - length(replace(c.body, '{sign}', '')), {most})"


#: Features of a proposal c whose digits are d and digit groups g: small
#: whole numbers.
CUE = "CASE " + " ".join(f"WHEN c.before rlike {literal(rf'(?:^|[^a-z])(?:{w})[^a-z0-9]*$')} THEN {k}" for k, w in CUES.items()) + " ELSE 0 END"
FEATURES = {
    "kind": "c.kind",
    "digits": "least(length(d), 20)",
    "luhn": "if(length(d) BETWEEN 13 AND 19 AND luhn_check(d), 1, 0)",
    "lead": "if(d = '', 10, cast(left(d, 1) as int))",
    "plus": "if(left(c.body, 1) = '+', 1, 0)",
    "paren": counted("(", 3),
    "spaces": counted(" ", 8),
    "dashes": counted("-", 8),
    "dots": counted(".", 8),
    "slashes": counted("/", 4),
    "groups": "least(size(g), 12)",
    "longest": "least(coalesce(array_max(transform(g, x -> length(x))), 0), 20)",
    "shortest": "least(coalesce(array_min(transform(g, x -> length(x))), 0), 20)",
    "last": "least(length(coalesce(get(g, size(g) - 1), '')), 20)",
    "date": r"if(c.body rlike '(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)', 1, 0)",
    "colons": counted(":", 8),
    "gap": "if(instr(c.body, '::') > 0, 1, 0)",
    "hex": "if(c.body rlike '(?i)[a-f]', 1, 0)",
    "at": f"CASE WHEN instr(c.body, '@') > 0 THEN 1 WHEN c.body rlike {literal(r'(?i)[(\[{]at')} THEN 2 "
          f"WHEN c.body rlike {literal(r'＠')} THEN 3 WHEN c.body rlike '(?i) at ' THEN 4 ELSE 0 END",
    "dot": f"CASE WHEN c.body rlike {literal(r'(?i)[(\[{]dot')} THEN 2 WHEN c.body rlike '(?i) dot ' THEN 3 "
           f"WHEN instr(c.body, '.') > 0 THEN 1 ELSE 0 END",
    "tld": f"least(length(regexp_extract(c.body, {literal(r'(\p{L}+)$')}, 1)), 12)",
    "cue": CUE,
    "left": f"CASE WHEN c.before = '' THEN 0 WHEN c.before rlike {literal(r'\s$')} THEN 1 WHEN c.before rlike {literal(r'[\p{L}\p{N}]$')} THEN 2 ELSE 3 END",
    "right": f"CASE WHEN c.after = '' THEN 0 WHEN c.after rlike {literal(r'^\s')} THEN 1 WHEN c.after rlike {literal(r'^[\p{L}\p{N}]')} THEN 2 ELSE 3 END",
}


def features(then: str) -> str:
    """SQL: ``then`` with the proposal bound to c, its digits to d, their
    groups to g and its features to f."""
    made = ", ".join(f"'{n}', {s}" for n, s in FEATURES.items())
    return (f"transform(array(regexp_replace(c.body, '[^0-9]', '')), d -> "
            f"transform(array(regexp_extract_all(c.body, '[0-9]+', 0)), g -> "
            f"transform(array(named_struct({made})), f -> {then})[0])[0])[0]")


def drawn(spark: SparkSession) -> DataFrame:
    """(text, kind, label) of lines drawn by rule: one span of each kind in
    spellings the patterns miss, or a look-alike, between words."""
    rows = spark.range(DRAWN).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = rows.select("id", "h", F.translate("h", "abcdef", "012345").alias("d"), F.translate("h", "0123456789", "ghijklmnop").alias("w"))
    n = lambda at, k: f"substr(d, {at}, {k})"
    x = lambda at, k: f"substr(h, {at}, {k})"
    w = lambda at, k: f"substr(w, {at}, {k})"
    j = lambda *p: f"concat({', '.join(p)})"
    q = lambda s: f"'{s}'"

    def checked(body: str, right: bool) -> str:
        sign = "" if right else "NOT "
        return f"concat({body}, get(filter(sequence(0, 9), i -> {sign}luhn_check(concat({body}, i))), 0))"

    def cut(number: str, sizes: tuple[int, ...], sign: str) -> str:
        at, parts = 1, []
        for k in sizes:
            parts.append(f"substr({number}, {at}, {k})")
            at += k
        return f"concat_ws('{sign}', {', '.join(parts)})"

    card, amex, wrong = (checked(b, r) for b, r in ((j(q("4"), n(2, 14)), True), (j(q("37"), n(3, 12)), True), (j(q("4"), n(2, 14)), False)))
    fours = (4, 4, 4, 4)
    v6 = cut(x(1, 32), (4,) * 8, ":")
    year = "concat(if(id % 2 = 0, '19', '20'), substr(d, 3, 2))"
    spelled = {
        0: [j(w(1, 6), q(" (at) "), w(9, 5), q(" (dot) com")), j(w(1, 5), q("[at]"), w(9, 5), q("[dot]org")), j(w(1, 7), q(" at "), w(9, 6), q(" dot net")),
            j(w(1, 4), q("é"), w(5, 2), q("@"), w(9, 5), q(".fr")), j(w(1, 6), q("＠"), w(9, 5), q(".de")), j(w(1, 6), q("@"), w(9, 6), q(".com")),
            j(w(1, 6), q(" (at) "), w(9, 5), q(".com"))],
        1: [v6, j(x(1, 4), q("::"), x(5, 4)), j(q("fe80::"), cut(x(9, 12), (4, 4, 4), ":")), j(q("2001:db8::"), x(3, 2), q(":"), x(9, 3))],
        2: [cut(card, fours, "."), cut(card, fours, "/"), cut(card, fours, "  "), cut(amex, (4, 6, 5), " "), cut(amex, (4, 6, 5), "-"), amex,
            cut(card, fours, " "), card],
        3: [j(q("("), n(1, 3), q(") "), n(4, 3), q("-"), n(7, 4)), cut(n(1, 10), (3, 3, 4), "-"), cut(n(1, 10), (3, 3, 4), "."),
            j(q("00"), n(1, 2), q(" "), n(3, 3), q(" "), n(6, 3), q(" "), n(9, 3)), j(q("0"), n(1, 3), q("/"), n(5, 7)), j(q("0"), cut(n(2, 9), (1, 2, 2, 2, 2), " ")),
            j(q("+"), n(1, 2), q(" "), n(3, 3), q("/"), n(6, 6))],
    }
    other = {
        0: [j(w(1, 5), q(" at "), w(6, 4), q(".")), j(n(1, 1), q("@"), n(2, 2), q(".50")), j(w(1, 4), q("@"), w(5, 3), q(".1")), j(w(1, 4), q(" at "), n(3, 2), q(".30"))],
        1: [cut(n(1, 6), (2, 2, 2), ":"), cut(x(1, 12), (2,) * 6, ":"), j(n(1, 1), q(":"), n(2, 2), q(":"), n(4, 2)), cut(n(1, 4), (1, 1, 1, 1), ":"), q("a::b")],
        2: [wrong, cut(wrong, fours, " "), cut(wrong, fours, "-"), cut(wrong, fours, "."), n(1, 13), n(1, 20), cut(n(1, 16), (1,) * 16, " "),
            j(q("978-3-"), n(1, 2), q("-"), n(3, 6), q("-"), n(9, 1))],
        3: [j(year, q("-0"), "1 + id % 9", q("-"), n(1, 2)), j(n(1, 2), q(".0"), "1 + id % 9", q("."), year), j(year, q(" "), year, q(" "), year),
            n(1, 9), n(1, 12), n(1, 16), cut(n(1, 9), (3, 3, 3), "."), j(n(1, 1), q("."), n(2, 9)), j(n(1, 4), q("/"), n(5, 4)), cut(n(1, 12), (2,) * 6, " "),
            j(q("978-3-"), n(1, 2), q("-"), n(3, 6), q("-"), n(9, 1)), j(year, q("-"), year), cut(n(1, 16), (4, 4, 4, 4), " ")],
    }
    cue = {0: ["email", "contact", "mailto"], 1: ["ip", "host", "server"], 2: ["card", "visa", "credit card"], 3: ["tel", "phone", "call", "fax"]}
    off = ["order", "invoice", "isbn", "ref", "version", "id", "date"]
    lines = []
    for label, table in ((1, spelled), (0, other)):
        for kind, bodies in table.items():
            for k, body in enumerate(bodies):
                words = cue[kind] if label else off
                said = f"element_at(array({', '.join(map(q, words))}), cast(1 + id % {len(words)} as int))"
                # bare ten-digit and lone digit forms are personal data only behind a cue
                alone = "false" if label and kind == 3 and k in (1, 2, 4, 5) else "id % 2 = 0"
                lines.append(f"named_struct('text', concat(substr(w, 40, 6), ' ', if({alone}, '', concat({said}, if(id % 3 = 0, ': ', ' '))), "
                             f"{body}, if(id % 5 = 0, '.', ''), ' ', substr(w, 50, 5)), 'kind', {kind}, 'label', {label})")
                if label and kind == 3 and k in (1, 2, 4, 5):  # the same behind a word for another number is none
                    against = f"element_at(array({', '.join(map(q, off))}), cast(1 + id % {len(off)} as int))"
                    lines.append(f"named_struct('text', concat(substr(w, 40, 6), ' ', if(id % 2 = 0, '', concat({against}, ' ')), {body}, ' ', substr(w, 50, 5)), "
                                 f"'kind', {kind}, 'label', 0)")
    one = F.expr(f"array({', '.join(lines)})")
    return rows.select(F.explode(one).alias("l")).select("l.*")


def labelled(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """(part, features..., label): proposals of the drawn lines and of at
    most ``limit`` texts, with a part from 0 to 3 by hash."""
    spark = docs.sparkSession
    lines = proposals(drawn(spark))
    made = lines.select("text", F.expr("kind").alias("of"), "label", F.explode(F.expr("flatten(flatten(runs))")).alias("c"))
    # the whole span of a line carries its label; a card line says nothing
    # about phones and the other way round
    made = made.where("c.kind = of").select("c", "label")
    few = materialize(sample(docs, text_col, limit)).select(F.lit(None).cast("long").alias("doc_id"), "text")
    seen = proposals(with_base(few, "doc_id", "text")).select("base", F.explode(F.expr("flatten(flatten(runs))")).alias("c"))
    taken = "exists(base, b -> b.kind = c.kind AND b.start = c.start AND b.end = c.end)"
    refused = ("c.kind = 2 AND NOT exists(base, b -> b.start < c.end AND c.start < b.end) "
               "AND length(regexp_replace(c.body, '[^0-9]', '')) BETWEEN 16 AND 19")
    seen = seen.select("c", F.expr(f"CASE WHEN {taken} THEN 1 WHEN {refused} THEN 0 END").alias("label")).where("label IS NOT NULL")
    rows = made.unionByName(seen).select(F.expr(features("f")).alias("f"), "label", F.expr("pmod(xxhash64(c.body), 4)").alias("part"))
    return rows.select("part", "f.*", "label")


def fit_trees(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, list]:
    """Gradient-boosted trees for weighted rows of small whole numbers: the
    first score, and trees as nested (feature, at most, left, right)."""
    first = math.log((y @ n + 1) / ((1 - y) @ n + 1))
    score, trees = np.full(len(y), first), []

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    def grow(rows: np.ndarray, depth: int):
        g, h = grad[rows], hess[rows]
        best = (1e-6, None, None)
        if depth and n[rows].sum() >= 2 * LEAST_ROWS:
            for k in range(x.shape[1]):
                values = x[rows, k]
                size = int(values.max()) + 1
                gs, hs, ns = (np.cumsum(np.bincount(values, v, size))[:-1] for v in (g, h, n[rows]))
                ok = (ns >= LEAST_ROWS) & (n[rows].sum() - ns >= LEAST_ROWS)
                if ok.any():
                    won = np.where(ok, gain(gs, hs) + gain(g.sum() - gs, h.sum() - hs) - gain(g.sum(), h.sum()), 0)
                    if won.max() > best[0]:
                        best = (won.max(), k, int(won.argmax()))
        if best[1] is None:
            value = round(float(RATE * g.sum() / (h.sum() + 1.0)), 6)
            score[rows] += value
            return value
        _, k, at = best
        low = x[rows, k] <= at
        return k, at, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = (y - p) * n, p * (1 - p) * n
        trees.append(grow(np.arange(len(y)), DEPTH))
    return round(first, 6), trees


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    k, at, low, high = tree
    return f"if(f.{list(FEATURES)[k]} <= {at}, {tree_sql(low)}, {tree_sql(high)})"


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def calibrate(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over held-out scores, by Newton
    steps toward smoothed labels."""
    up, down = y @ n, (1 - y) @ n
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g, h = (t - p) * n, p * (1 - p) * n + 1e-9
        m = np.array([[h @ (score * score) + 1e-6, h @ score], [h @ score, h.sum() + 1e-6]])
        step = np.linalg.solve(m, np.array([g @ score, g.sum()]))
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return round(float(max(a, 1e-3)), 6), round(float(b), 6)


class Model:
    """Trees, calibration and the probability that each kind must reach
    (above 1 where no threshold keeps to ``WRONG``)."""

    def __init__(self, first: float, trees: list, a: float, b: float, least: list[float]):
        self.first, self.trees, self.a, self.b, self.least = first, trees, a, b, least

    def probability(self) -> str:
        total = " + ".join([f"{self.first!r}D", *map(tree_sql, self.trees)])
        return f"1D / (1D + exp(-({self.a!r}D * ({total}) + {self.b!r}D)))"


def train(docs: DataFrame, text_col: str = "text", limit: int = TRAIN_DOCS, rows_limit: int = TRAIN_ROWS) -> Model:
    names = list(FEATURES)
    table = labelled(docs, text_col, limit).groupBy("part", *names, "label").agg(F.count(F.lit(1)).alias("n"))
    rows = table.orderBy(F.xxhash64(*names, "label", "part"), *names, "label", "part").limit(rows_limit).collect()
    x, y, n = np.array([[r[k] for k in names] for r in rows], np.int64), np.array([r["label"] for r in rows], float), np.array([r["n"] for r in rows], float)
    n = np.minimum(n, 20.0)  # a frequent row must not drown the others
    held = np.array([r["part"] for r in rows]) == 0
    first, trees = fit_trees(x[~held], y[~held], n[~held])
    score = np.array([first + sum(tree_value(t, r) for t in trees) for r in x[held]])
    a, b = calibrate(score, y[held], n[held])
    p = 1 / (1 + np.exp(-(a * score + b)))
    least = []
    for kind in range(len(KINDS)):
        of = x[held][:, 0] == kind
        best = 2.0
        for cut in sorted(set(p[of].round(6)), reverse=True):
            chosen = of & (p >= cut)
            if n[held][chosen] @ (1 - y[held][chosen]) > WRONG * n[held][chosen].sum():
                break
            best = max(cut, 0.5)
        least.append(float(best))
    return Model(first, trees, a, b, least)


def clear_of(base: str, added: str) -> str:
    """SQL: the spans of ``added`` (disjoint, by start) that overlap none of
    ``base``.  One ordered walk in blocks: ``reach`` is the furthest end of a
    base span so far, ``held`` the last added span until it is safe."""
    kind = "struct<start:int,base:int,end:int,kind:int>"
    merged = (f"array_sort(concat(transform({base}, x -> named_struct('start', x.start, 'base', 0, 'end', x.end, 'kind', x.kind)), "
              f"transform({added}, x -> named_struct('start', x.start, 'base', 1, 'end', x.end, 'kind', x.kind))))")
    none = f"cast(null as {kind})"
    step = (f"(s, x) -> CASE WHEN x.base = 0 THEN named_struct('reach', greatest(s.reach, x.end), 'held', if(s.held.end > x.start, {none}, s.held), 'out', s.out) "
            f"ELSE named_struct('reach', s.reach, 'held', if(x.start < s.reach, {none}, x), 'out', if(s.held IS NULL, s.out, array_append(s.out, s.held))) END")
    empty = f"cast(array() as array<{kind}>)"
    block = f"aggregate(slice(l, 256 * i + 1, 256), named_struct('reach', s.reach, 'held', s.held, 'out', {empty}), {step})"
    walk = (f"transform(array({merged}), l -> aggregate(sequence(0, (size(l) - 1) div 256), named_struct('reach', 0, 'held', {none}, 'out', {empty}), "
            f"(s, i) -> transform(array({block}), r -> named_struct('reach', r.reach, 'held', r.held, 'out', concat(s.out, r.out)))[0], "
            f"s -> if(s.held IS NULL, s.out, array_append(s.out, s.held))))[0]")
    plain = f"transform({walk}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    none_added = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
    return f"if(size({added}) = 0, {none_added}, {plain})"


def find_personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans (start, kind, end); base by
    kind, then start, added by start."""
    rows = proposals(with_base(docs, id_col, text_col))
    least = f"get(array({', '.join(f'{t!r}D' for t in model.least)}), c.kind)"
    judged = features(f"named_struct('p', {model.probability()}, 'kind', c.kind, 'start', c.start, 'end', c.end)")
    # of a span its likeliest kind; of a run the whole, unless a part is likelier
    best = f"transform(r, v -> array_max(filter(transform(v, c -> {judged}), c -> c.p >= {least})))"
    top = "coalesce(array_max(transform(slice(b, 2, greatest(size(b) - 1, 0)), c -> c.p)), 0D)"
    chosen = f"transform(array({best}), b -> if(b[0].p >= {top}, array(b[0]), filter(slice(b, 2, greatest(size(b) - 1, 0)), c -> c IS NOT NULL)))[0]"
    rows = rows.withColumn("added", F.expr(f"coalesce(flatten(transform(runs, r -> {chosen})), array())"))
    rows = rows.withColumn("added", F.expr("transform(added, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"))
    rows = rows.withColumn("base", F.expr("transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"))
    return rows.select("doc_id", "base", F.expr(clear_of("base", "added")).alias("added"))


def span_names(spans_col: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans_col}, x -> concat(array({kinds})[x.kind], ':', x.start, ':', x.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, hash of the base spans and all spans, both by
    kind, then start."""

    def count(kind: int) -> Column:
        return F.expr(f"cast(size(filter(base, x -> x.kind = {kind})) as bigint)")

    order = "(x, y) -> CASE WHEN x.kind != y.kind THEN x.kind - y.kind WHEN x.start != y.start THEN x.start - y.start ELSE x.end - y.end END"
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(F.expr(span_names("base")), 256).alias("base_sha256"),
                        F.expr(span_names(f"array_sort(concat(base, added), {order})")).alias("spans"))
