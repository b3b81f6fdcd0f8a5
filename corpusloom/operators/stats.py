"""Statistics over examples and steps.

All are grouped aggregates with map-side partial aggregation; reports that
are "top-k" use ``orderBy().limit()`` which plans as a per-partition top-k
(TakeOrderedAndProject), never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_counts(df: DataFrame, key: str, k: int = 10, count_col: str = "n") -> DataFrame:
    """A4: the k most frequent values; ties broken by value (D3)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(count_col).desc(), F.col(key).asc()).limit(k))


def mean_upper_median(df: DataFrame, col: str) -> DataFrame:
    """A3: mean and the upper median ``sorted(x)[n // 2]`` of an integer column.

    Exact without ranking the rows: a histogram of distinct values (partial
    aggregation), then a running count and a total over the distinct values in
    one ordered pass. For the integer measures it is meant for (lines of a
    length-gated file) there are few distinct values. The input is read once.
    """
    hist = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    running = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = hist.select(col, "_c", F.sum("_c").over(running).alias("_cum"), F.sum("_c").over(everything).alias("_n"))
    return cum.agg(
        F.round(F.sum(F.col(col) * F.col("_c")) / F.sum("_c"), 9).alias(f"mean_{col}"),
        F.min(F.when(F.col("_cum") > F.floor(F.col("_n") / 2), F.col(col))).cast("long").alias(f"median_{col}"))


def duplicate_count(df: DataFrame, hash_col: str) -> DataFrame:
    """A5: rows whose hash already appeared = count - count distinct."""
    per = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg((F.sum("_c") - F.count(F.lit(1))).cast("long").alias("duplicate_count"))


def distributions(df: DataFrame, keys: list[str]) -> DataFrame:
    """A1: counts by each key separately plus the total, in one pass (GROUPING SETS)."""
    sets = [[k] for k in keys] + [[]]
    g = df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"),
                                         *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    dim = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys], F.lit("total"))
    val = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")) for k in keys], F.lit("all"))
    return g.select(dim.alias("dimension"), val.alias("value"), "n")


def share_of_total(df: DataFrame, key: str, count_col: str = "n") -> DataFrame:
    """Percentage of each group over the (already aggregated, small) rows."""
    # one row per group: the total over them reads the input once, a scalar subquery twice
    total = F.sum(count_col).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select(key, count_col, F.round(F.col(count_col) * 100.0 / total, 6).alias("pct"))
