"""Connected components of a link table, by alternating star contraction.

Every round joins each node's neighbours to the smallest one, first among
the larger neighbours, then among the smaller; the forest ends as stars
around the smallest node of each component.  Links stay rows of a
DataFrame: nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salarium.session import materialize


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where(F.col("u") != F.col("v")).distinct())


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``u``, ``v``, any
    ordered type; self-links and repeated links are allowed): root is the
    smallest node of the component."""
    now = materialize(links.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == state or mark["n"] == 0:
            break
        state = mark
        now = materialize(small_star(large_star(now)))
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
