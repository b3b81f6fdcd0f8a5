"""Connected components of a link table, wholly in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import shared_table

MAX_ROUNDS = 64     # never needed: each round at least halves the longest path to a smallest vertex


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex that a link touches; root is the smallest vertex of its component.

    links: columns a, b of one sortable type, any order, repeats and self-links allowed. Alternates two
    rewritings of the link table until it is a set of stars: every vertex hands the smallest vertex
    it sees to its larger neighbours, then to its smaller ones. Each round is written to the
    shared folder, so a lost executor costs at most one round.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    now = shared_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(first, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
            .where("u > v").distinct())
        now = shared_table(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
