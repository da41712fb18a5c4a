"""Trigram fuzzy name search (the trigram-index feature of the reference).

Semantics follow the usual trigram similarity: text is lower-cased, split
into words of letters/digits, each word padded with two spaces in front and
one behind, and its 3-character windows form a set; similarity is
|shared| / |union| of the two sets.  Everything is built-in higher-order
array functions, evaluated per row on the executors; the search term's
trigram set is a literal of the plan, so no join is needed, and the column's
trigrams are built once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.functions.numeric import INDEX_DIGITS

# Fixed value: default similarity threshold of the reference's trigram search.
DEFAULT_THRESHOLD = 0.3
NON_WORD = r"[^\p{L}\p{N}]+"


def trigrams(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), NON_WORD, " ")), " "),
                     lambda w: w != F.lit(""))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2),
                                                      lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def term_trigrams(term: str) -> list[str]:
    """The same set for a constant, built once for the plan."""
    words = "".join(c if c.isalnum() else " " for c in term.lower()).split()
    return list(dict.fromkeys(f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)))


def similarity(column: Column, term: str) -> Column:
    grams = term_trigrams(term)
    constant = F.array(*[F.lit(g) for g in grams]) if grams else F.array().cast("array<string>")

    def share(own: Column) -> Column:
        inter = F.size(F.array_intersect(own, constant))
        return F.coalesce(F.try_divide(inter.cast("double"), (F.size(own) + len(grams) - inter).cast("double")), F.lit(0.0))

    # bound once: the set is used three times
    return F.transform(F.array(trigrams(column)), share).getItem(0)


def fuzzy_search(df: DataFrame, column: str, term: str,
                 threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows of ``df`` whose ``column`` is trigram-similar to ``term``
    (similarity >= threshold), with the similarity; a NULL is not similar."""
    return (df.withColumn("similarity", F.round(similarity(F.col(column), term), INDEX_DIGITS))
              .where(F.col("similarity") >= F.lit(threshold)))
