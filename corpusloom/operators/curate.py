"""Curation: exact dedupe, category balancing, seeded shuffle.

Scale notes
-----------
* Dedupe aggregates ids by the whole text hash (hash aggregation, collapsed on
  the map side) and takes the repeats out of the input by id; texts are not
  shuffled for the grouping.
* Balancing never ranks a whole category in one task. The kept ids are picked
  on narrow columns with a salted two-level top-k (exact); the plan of rows and
  copies is at most ``max_per_category`` + ``min_per_category`` rows per category
  and is joined to the rows once (AQE broadcasts it when its measured size allows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.functions.text import hash16, seeded_draw


def text_key(col) -> Column:
    """The whole SHA-256 of a text, as 32 bytes: what texts are compared by."""
    return F.unhex(F.sha2(F.col(col) if isinstance(col, str) else col, 256))


def first_ids(df: DataFrame, key: Column, id_col: str, **measures: Column) -> DataFrame:
    """(key, id_col, measures): the smallest id of each distinct text key.

    Only keys and ids are shuffled. Measures are numbers that depend on the text alone
    and are computed before the shuffle.
    """
    narrow = df.select(key.alias("_key"), F.col(id_col), *[m.alias(n) for n, m in measures.items()])
    return narrow.groupBy("_key").agg(F.min(id_col).alias(id_col), *[F.min(n).alias(n) for n in measures])


def exact_dedupe(df: DataFrame, text_col: str, order_cols: list[str], hash_col: str = "content_hash",
                 keep_hash: bool = True, key: Column | None = None) -> DataFrame:
    """O2: keep the first row (by ``order_cols``, which name a row) per distinct text.

    Texts are told apart by the whole SHA-256; ``hash_col`` is its 16-hex label. The
    shuffles carry keys and ids only: rows that repeat an earlier one, normally the
    small side, are found on them and taken out of the input. Rows
    without a text are all kept.
    """
    key = text_key(text_col) if key is None else key
    narrow = df.select(key.alias("_key"), *order_cols)
    groups = narrow.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *(
        [F.min(order_cols[0]).alias("_first")] if len(order_cols) == 1
        else [F.min(F.struct(*order_cols)).alias("_first")]))
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    repeats = narrow.join(groups.where("_n > 1"), "_key").where(order > F.col("_first")).select(*order_cols)
    kept = df.join(repeats, order_cols, "left_anti").select(*df.columns)
    if hash_col in df.columns or not keep_hash:
        return kept
    return kept.withColumn(hash_col, hash16(text_col))


def _top_k_ids(narrow: DataFrame, group_col: str, id_col: str, draw_col: str, k: int,
               salt_buckets: int) -> DataFrame:
    """Exact top-k smallest (draw, id) per group, in two salted rounds.

    Round 1 ranks inside (group, salt); round 2 ranks the <= k x salt_buckets
    survivors per group. The global top-k is always inside the survivors.
    """
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group_col, "_salt").orderBy(draw_col, id_col)
    survivors = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    w2 = Window.partitionBy(group_col).orderBy(draw_col, id_col)
    return survivors.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= k).drop("_rn")


def first_k_per_group(df: DataFrame, group_col: str, order_cols: list[str], k: int,
                      salt_buckets: int = 64) -> DataFrame:
    """First k rows per group by ``order_cols`` (A7, W17), skew-safe.

    Ranks inside (group, salt) first, then ranks the <= k x salt_buckets
    survivors per group, so a hot group is split across tasks. Each round is
    a ``row_number() <= k`` filter, planned with a partial WindowGroupLimit
    before the exchange (map-side top-k).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order_cols]), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group_col, "_salt").orderBy(*order_cols)
    survivors = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    w2 = Window.partitionBy(group_col).orderBy(*order_cols)
    return survivors.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= k).drop("_rn")


def replace_first(col: Column, old: str, new: Column) -> Column:
    """Replace the first occurrence of ``old`` (plain text) with ``new``."""
    pos = F.instr(col, old)
    return F.when(pos > 0, F.concat(F.substring(col, F.lit(1), pos - 1), new,
                                    F.substring(col, pos + F.lit(len(old)), F.lit(1 << 30)))).otherwise(col)


def balance_categories(df: DataFrame, category_col: str, id_col: str, seed: str = "balance",
                       min_per_category: int = R.MIN_PER_CATEGORY, max_per_category: int = R.MAX_PER_CATEGORY,
                       instruction_col: str | None = None, variations=R.INSTRUCTION_VARIATIONS,
                       variation_targets=R.VARIATION_TARGETS, salt_buckets: int = 64) -> DataFrame:
    """W4 = W2 (down to max by a seeded draw) + W3 (up to min with reworded
    copies) + pass-through. Adds ``variation`` (bool) and ``copy_no`` (0 for
    originals). Requires ``id_col`` to be unique."""
    # everything is decided on ids: the rows themselves are joined once, to the plan
    narrow = df.select(category_col, id_col, seeded_draw(seed, F.col(id_col)).alias("_draw"))
    # W2 and pass-through: the max_per_category smallest draws, which are all rows of smaller categories
    keep = _top_k_ids(narrow, category_col, id_col, "_draw", max_per_category, salt_buckets)
    # Kept rows of a category under the floor are all its rows; some get copies
    group = Window.partitionBy(category_col)
    ranked = (keep.select(category_col, id_col)
              .withColumn("_n", F.count(F.lit(1)).over(group))
              .withColumn("_pos", F.row_number().over(group.orderBy(id_col))))
    # the draw of each copy names the position it is made from
    number = F.sequence(F.lit(1), F.greatest(F.lit(min_per_category) - F.col("_n"), F.lit(1)))
    mine = F.filter(number, lambda c: (F.col("_n") < min_per_category) & (
        F.lit(1) + F.pmod(seeded_draw(seed, F.col(category_col), c), F.col("_n")) == F.col("_pos")))
    plan = ranked.select(F.col(id_col).alias("_id"), F.explode(F.concat(
        F.array(F.lit(0)), mine.cast("array<int>"))).alias("copy_no"))
    # at most (max_per_category + min_per_category) rows per category; unhinted, so AQE checks its size
    rows = df.join(plan, F.col(id_col) == F.col("_id")).drop("_id")
    variation = F.col("copy_no") > 0
    if instruction_col is not None:
        new_instr = F.col(instruction_col)
        for j, target in enumerate(variation_targets):
            pick = F.element_at(F.array(*[F.lit(v) for v in variations]),
                                (F.pmod(seeded_draw(seed, F.lit(f"v{j}"), F.col(category_col), F.col("copy_no")),
                                        F.lit(len(variations))) + 1).cast("int"))
            new_instr = replace_first(new_instr, target, pick)
        rows = rows.withColumn(instruction_col, F.when(variation, new_instr).otherwise(F.col(instruction_col)))
    return rows.select(*df.columns, variation.alias("variation"), "copy_no")


def shuffle_seeded(df: DataFrame, id_col: str, seed: str = "shuffle") -> DataFrame:
    """A reproducible random order (range-partitioned global sort on md5)."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))) \
             .orderBy("shuffle_key", id_col)
