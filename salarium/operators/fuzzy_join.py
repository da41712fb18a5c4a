"""Similarity join of names: all pairs of different texts whose trigram sets
have a Jaccard similarity of at least a threshold.

No text meets every other.  The grams of a text are ordered rarest first; two
sets that are similar enough must share a gram among the first few of each
(the prefix filter), so an inverted join on those grams finds every pair.
The smaller set of a pair needs a shorter prefix than the larger one, so a
text is posted in two roles.  Rows of one gram are compared only if their
sizes allow the similarity and enough grams are left behind the shared one
(length and position filters).

A gram of more than ``HOT`` texts is split: similar sets share a second gram
in prefixes one longer, so such texts meet under pairs of grams instead.
That is exact: a pair meets under its first shared gram, or, if that is hot,
under its first two.

Only keys, sizes and signatures meet.  A signature has a bit for the parity of
the grams that hash to it, so two of them differ in no more bits than the sets
do in grams: pairs of more differing bits than similar sets may have go at
once, and grams are compared only for the few pairs that are left.

Equal texts are one row: it carries the smallest key, and ``members`` maps
every row to it.  Null texts and texts without a letter or digit take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.functions.numeric import INDEX_DIGITS
from salarium.operators.fuzzy import trigrams
from salarium.session import materialize

#: Texts under one gram from which it is split.
HOT = 300
#: Longs of a signature.
SIGNATURE = 4


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_key, class_size): every row with the smallest key of the
    rows of its text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    classes = rows.groupBy("text").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "text").select(F.col("key").alias(key), "class_key", "class_size")


def gram_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grams) of each different text, with its smallest key."""
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = texts.groupBy("text").agg(F.min("key").alias("key"))
    return texts.select("key", trigrams("text").alias("grams")).where(F.size("grams") > 0)


def ordered(sets: DataFrame, hot: int) -> DataFrame:
    """(side, key, grams, hot): grams rarest first over all sides; ``hot``
    tells which of them are in too many texts."""
    each = sets.select("side", "key", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a gram of very many texts makes a skewed join, which AQE splits; one row
    # a gram on the other side
    rows = each.join(counts, "gram").groupBy("side", "key").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o"))
    return rows.select("side", "key", F.col("o.gram").alias("grams"), F.transform("o.df", lambda d: d > hot).alias("hot"))


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` with the size of the set, its signature, ``n`` and ``s0`` ...,
    and its grams as numbers: three code points of 21 bits each."""
    bits = "cast(shiftright(h, 2) & 63 as int)"
    words = [F.expr(f"aggregate(transform(grams, g -> xxhash64(g)), 0L, (s, h) -> s ^ if(pmod(h, {SIGNATURE}) = {w}, shiftleft(1L, {bits}), 0L))").alias(f"s{w}")
             for w in range(SIGNATURE)]
    code = "shiftleft(cast(ascii(g) as bigint), 42) | shiftleft(cast(ascii(substr(g, 2)) as bigint), 21) | cast(ascii(substr(g, 3)) as bigint)"
    return rows.select("*", F.size("grams").alias("n"), F.expr(f"transform(grams, g -> {code})").alias("codes"), *words)


def posted(rows: DataFrame, threshold: float, smaller: bool) -> DataFrame:
    """One row for each join key of a text in the role of the smaller or the
    larger set: (k1, k2, at, side, key, grams).  ``at`` is the place of the
    key's last gram; k2 is empty for a single gram.

    Similar sets x, y share at least t / (1 + t) (|x| + |y|) grams, that is
    2 t / (1 + t) |x| for the smaller one and t |y| for the larger one (a
    hair less, as similarities are rounded)."""
    n = F.size("grams")
    share = 2 * threshold / (1 + threshold) if smaller else threshold
    first = n - F.greatest(F.ceil(n * F.lit(share) - F.lit(1e-6)), F.lit(1)).cast("int") + 1
    lone = n * F.lit(threshold) <= F.lit(1 + 1e-6)  # one shared gram may be enough
    single = F.filter(F.transform(F.sequence(F.lit(1), first), lambda i: F.struct(
        F.element_at("grams", i).alias("k1"), F.lit("").alias("k2"), i.alias("at"), (~F.element_at("hot", i) | lone).alias("use"))), lambda x: x["use"])
    second = F.least(first + 1, n)
    hot = F.filter(F.sequence(F.lit(1), second), lambda i: F.element_at("hot", i))  # most texts have none
    double = F.flatten(F.transform(hot, lambda h: F.transform(
        F.filter(F.sequence(F.lit(1), second), lambda j: (j > h) | ((j < h) & ~F.element_at("hot", j))),
        lambda j: F.struct(F.element_at("grams", F.least(h, j)).alias("k1"), F.element_at("grams", F.greatest(h, j)).alias("k2"),
                           F.greatest(h, j).alias("at"), F.lit(True).alias("use")))))
    kept = [c for c in rows.columns if c != "hot"]
    return rows.select(*kept, F.explode(F.concat(single, double)).alias("x")).select(*kept, "x.k1", "x.k2", "x.at")


def fuzzy_pairs(left: DataFrame, left_key: str, left_text: str, threshold: float, right: DataFrame | None = None,
                right_key: str | None = None, right_text: str | None = None, hot: int = HOT) -> DataFrame:
    """(left_key, right_key, similarity) of all pairs of different texts that
    are similar enough; of two tables, or of one with itself (then left_key <
    right_key, each pair once).  Equal texts of two tables are a pair too."""
    sets = gram_sets(left, left_key, left_text).withColumn("side", F.lit(0))
    if right is not None:
        sets = sets.unionByName(gram_sets(right, right_key, right_text).withColumn("side", F.lit(1)))
    rows = materialize(signed(ordered(sets, hot)))
    words = [f"s{w}" for w in range(SIGNATURE)]

    def role(smaller: bool) -> DataFrame:
        found = posted(rows, threshold, smaller)
        return found.select("side", "key", "n", *words, "at", (F.col("k2") == "").alias("lone"), F.xxhash64("k1", "k2").alias("h"))

    a, b = role(True).alias("a"), role(False).alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    after = F.col("a.key") < F.col("b.key") if right is None else F.col("a.side") < F.col("b.side")
    roles = (n < m) | ((n == m) & after)
    if right is not None:
        roles = roles & (F.col("a.side") == 1 - F.col("b.side"))
    need = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    possible = F.when(F.col("a.lone"), 1).otherwise(2) + F.least(n - F.col("a.at"), m - F.col("b.at"))
    differ = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words[1:]), F.bit_count(F.col(f"a.{words[0]}").bitwiseXOR(F.col(f"b.{words[0]}"))))
    fits = (n >= m * F.lit(threshold) - F.lit(1e-6)) & (differ <= n + m - 2 * need) & (possible >= need)
    # Sizes are known only once the keys are dealt out: neither side may be
    # broadcast by the size it has before.  Keys of equal hash only bring
    # pairs that the grams rule out
    met = a.join(b.hint("merge"), (F.col("a.h") == F.col("b.h")) & roles & fits)
    met = met.select(F.struct("a.side", "a.key").alias("x"), F.struct("b.side", "b.key").alias("y")).distinct()
    grams = rows.select(F.struct("side", "key").alias("x"), "codes")  # a struct: a null key finds itself
    met = met.join(grams, "x").join(grams.toDF("y", "codes2"), "y")
    shared = F.size(F.array_intersect("codes", "codes2"))
    similarity = F.round(shared.cast("double") / (F.size("codes") + F.size("codes2") - shared).cast("double"), INDEX_DIGITS)
    swap = F.col("x.key") > F.col("y.key") if right is None else F.col("x.side") > F.col("y.side")
    found = met.select(F.when(swap, F.col("y.key")).otherwise(F.col("x.key")).alias("left_key"),
                       F.when(swap, F.col("x.key")).otherwise(F.col("y.key")).alias("right_key"), similarity.alias("similarity"))
    return found.where(F.col("similarity") >= F.lit(threshold))


def link_counts(pairs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """One row a row of the table: (key, class_key, class_size, links), the
    number of other texts similar to its own."""
    ends = pairs.select(F.explode(F.array("left_key", "right_key")).alias("class_key"))
    links = ends.groupBy("class_key").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(links, "class_key", "left").select(key, "class_key", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
