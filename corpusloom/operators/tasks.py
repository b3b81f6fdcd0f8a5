"""Task classification and decomposition into subtask DAGs (T1-T6, W13, W14,
X16-X20, J4, J5, J8, A12).

A task row carries its strategy parameters as columns; each strategy emits
its subtasks with ``explode(sequence(...))`` inside the scan stage (no
shuffle), and edges are derived from the same rows. Unknown types take the
generic one-subtask DAG.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom import rules as R

SUBTASK_COLS = ["task_id", "strategy", "subtask_id", "name", "category", "weight", "priority", "chunk"]


def _lookup(mapping: dict, key: Column, default) -> Column:
    m = F.create_map(*sum([[F.lit(k), F.lit(v)] for k, v in mapping.items()], []))
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def adaptive_chunks(total_items: Column, complexity: Column, resources: Column, clamp: bool = True) -> Column:
    """int(min(min(16, resources), max(1, floor(items*complexity/10))) * 0.8).

    ``clamp`` (default, D6) raises a zero result to 1.
    """
    effective = total_items.cast("double") * complexity
    optimal = F.least(F.least(F.lit(R.MAX_CHUNKS), resources).cast("double"),
                      F.greatest(F.lit(1.0), F.floor(effective / F.lit(float(R.MIN_CHUNK_SIZE))).cast("double")))
    n = (optimal * F.lit(R.LOAD_BALANCING_FACTOR)).cast("int")
    return F.greatest(n, F.lit(1)) if clamp else n


def subtask_id(parent: Column, name: str, index: Column | None = None) -> Column:
    """parent_name-lower-with-underscores[_index]."""
    base = F.concat(parent.cast("string"), F.lit("_" + name.lower().replace(" ", "_")))
    return base if index is None else F.concat(base, F.lit("_"), index.cast("string"))


def range_chunk(i: Column, n_chunks: Column, total: Column, compat: bool = False) -> tuple[Column, Column]:
    """Chunk i covers [i*size, min((i+1)*size, total)), size = max(1, total // chunks).

    By default the last chunk ends at ``total`` (D6); ``compat`` loses the remainder.
    """
    size = F.greatest(F.lit(1), F.floor(total / n_chunks).cast("long"))
    start = i * size
    end = F.least((i + 1) * size, total)
    if not compat:
        end = F.when(i == n_chunks - 1, F.greatest(end, total)).otherwise(end)
    return start, end


def decompose(tasks: DataFrame, compat: bool = False) -> DataFrame:
    """One row per subtask. ``tasks`` needs task_id, task_type and the
    parameter columns (frame_count, resolution, available_gpus, has_audio,
    data_size, batch_size, model_type, portfolio_size, calculation_type,
    available_cpus); nulls take the strategy defaults.

    One scan, one ``explode(sequence(...))`` over slot numbers, then plain
    column expressions (whole-stage codegen, no per-element lambdas). Slots:
    video 0..n-1 chunks, n audio, n+1 merge; ml / financial -1 first stage,
    0..n-1 chunks, n last stage; generic 0.
    """
    V, M, Fi = R.VIDEO_DEFAULTS, R.ML_DEFAULTS, R.FINANCIAL_DEFAULTS
    strategy = _lookup(R.STRATEGY_ROUTES, F.col("task_type"), "generic")
    frames = F.coalesce(F.col("frame_count"), F.lit(V["frame_count"])).cast("long")
    rmult = _lookup(R.RESOLUTION_MULTIPLIERS, F.coalesce(F.col("resolution"), F.lit(V["resolution"])), 1.0)
    batch = F.coalesce(F.col("batch_size"), F.lit(M["batch_size"])).cast("long")
    data = F.coalesce(F.col("data_size"), F.lit(M["data_size"])).cast("long")
    mmult = _lookup(R.MODEL_MULTIPLIERS, F.coalesce(F.col("model_type"), F.lit(M["model_type"])), 1.0)
    n_batches = F.ceil(data / batch).cast("long")
    portfolio = F.coalesce(F.col("portfolio_size"), F.lit(Fi["portfolio_size"])).cast("long")
    cmult = _lookup(R.CALCULATION_MULTIPLIERS, F.coalesce(F.col("calculation_type"), F.lit(Fi["calculation_type"])),
                    1.0)
    gpus_v = F.coalesce(F.col("available_gpus"), F.lit(V["available_gpus"]))
    gpus_m = F.coalesce(F.col("available_gpus"), F.lit(M["available_gpus"]))
    cpus = F.coalesce(F.col("available_cpus"), F.lit(Fi["available_cpus"]))
    st = F.col("_strategy")
    base = tasks.select(
        F.col("task_id").cast("string").alias("task_id"), strategy.alias("_strategy"),
        F.coalesce(F.col("has_audio"), F.lit(True)).alias("_audio"),
        F.when(strategy == "video", rmult).when(strategy == "ml", mmult).when(strategy == "financial", cmult)
        .otherwise(F.lit(1.0)).alias("_mult"),
        F.when(strategy == "video", frames).when(strategy == "ml", n_batches).when(strategy == "financial", portfolio)
        .alias("_total"),
        F.when(strategy == "video", adaptive_chunks(frames, rmult, gpus_v))
        .when(strategy == "ml", adaptive_chunks(n_batches, mmult, gpus_m))
        .when(strategy == "financial", adaptive_chunks(portfolio, cmult, cpus)).otherwise(F.lit(0)).alias("_n"))
    n = F.col("_n")
    lo = F.when(st.isin("ml", "financial"), F.lit(-1)).otherwise(F.lit(0))
    hi = F.when(st == "video", n + 1).when(st.isin("ml", "financial"), n).otherwise(F.lit(0))
    slots = base.select("*", F.explode(F.sequence(lo, hi)).alias("_s"))
    slots = slots.filter(~((st == "video") & (F.col("_s") == n) & ~F.col("_audio")))
    s_, t, mult, total = F.col("_s"), F.col("task_id"), F.col("_mult"), F.col("_total")
    is_chunk = (st != "generic") & (s_ >= 0) & (s_ < n)
    cs, ce = range_chunk(s_, n, total, compat)
    span = (ce - cs)

    def sid(name, idx=None):
        return subtask_id(t, name, idx)

    kind = (F.when(st == "generic", "generic").when(is_chunk, "chunk")
            .when((st == "video") & (s_ == n), "audio").when(st == "video", "merge")
            .when(s_ == -1, "first").otherwise("last"))
    k = F.col("_kind")
    out = slots.withColumn("_kind", kind).select(
        "task_id", st.alias("strategy"),
        F.when(k == "generic", F.concat(t, F.lit("_generic")))
        .when(k == "chunk", F.when(st == "video", sid("frame_chunk", s_)).when(st == "ml", sid("inference_group", s_))
              .otherwise(sid("calc", s_)))
        .when(k == "audio", sid("audio")).when(k == "merge", sid("merge"))
        .when(k == "first", F.when(st == "ml", sid("data_prep")).otherwise(sid("market_data")))
        .otherwise(F.when(st == "ml", sid("aggregate")).otherwise(sid("risk_aggregate"))).alias("subtask_id"),
        F.when(k == "generic", F.lit("Generic Task Processing"))
        .when(k == "chunk", F.when(st == "video", F.concat(F.lit("Process Frames "), cs.cast("string"), F.lit("-"),
                                                            ce.cast("string")))
              .when(st == "ml", F.concat(F.lit("Inference Group "), s_.cast("string")))
              .otherwise(F.concat(F.lit("Calculate Portfolio Segment "), (s_ + 1).cast("string"))))
        .when(k == "audio", F.lit("Process Audio")).when(k == "merge", F.lit("Merge Video Stream"))
        .when(k == "first", F.when(st == "ml", F.lit("Prepare Data Pipeline")).otherwise(F.lit("Fetch Market Data")))
        .otherwise(F.when(st == "ml", F.lit("Aggregate Results")).otherwise(F.lit("Aggregate Risk Metrics")))
        .alias("name"),
        F.when(k == "generic", "cpu_tasks")
        .when(k == "chunk", F.when(st == "financial", F.lit("cpu_tasks")).otherwise(F.lit("gpu_tasks")))
        .when(k == "audio", "cpu_tasks").when(k == "merge", "io_tasks").when(k == "first", "io_tasks")
        .otherwise("cpu_tasks").alias("category"),
        F.when(k == "generic", F.lit(R.GENERIC_WEIGHT))
        .when(k == "chunk", F.when(st == "video", (span * mult) * F.lit(0.8))
              .when(st == "ml", (F.lit(3.0) * mult) * span)
              .otherwise((F.lit(3.0) * mult) * (span / total)))
        .when(k == "audio", F.lit(1.5)).when(k == "merge", F.lit(2.0) * mult)
        .when(k == "first", F.when(st == "ml", F.lit(2.0) * mult).otherwise(F.lit(2.0)))
        .otherwise(F.when(st == "ml", F.lit(1.0) * mult).otherwise(F.lit(1.5) * mult)).cast("double").alias("weight"),
        F.when(k.isin("merge", "first"), 3).when(k == "chunk", F.when(st == "video", 3).otherwise(2))
        .when(k == "last", F.when(st == "financial", 3).otherwise(2)).otherwise(2).alias("priority"),
        F.when(k == "chunk", s_).cast("int").alias("chunk"))
    return out


def edges(subtasks: DataFrame) -> DataFrame:
    """DAG edges (task_id, src, dst): fan-out from the first stage, fan-in to the last. One pass over the rows."""
    sid, task, st = F.col("subtask_id"), F.col("task_id"), F.col("strategy")
    is_chunk = F.col("chunk").isNotNull()
    first, last = _stage_ids()

    def edge(src, dst):
        return F.struct(src.alias("src"), dst.alias("dst"))

    found = F.array_compact(F.array(
        F.when((st == "video") & (sid != last), edge(sid, last)),
        F.when(st.isin("ml", "financial") & is_chunk, edge(first, sid)),
        F.when(st.isin("ml", "financial") & is_chunk, edge(sid, last))))
    return subtasks.select(task, F.explode(found).alias("e")).select("task_id", "e.src", "e.dst")


def _stage_ids() -> tuple[Column, Column]:
    """Ids of a task's first and last stage (null where the strategy has none)."""
    task, st = F.col("task_id"), F.col("strategy")
    first = F.when(st == "ml", F.concat(task, F.lit("_data_prep"))).when(
        st == "financial", F.concat(task, F.lit("_market_data")))
    last = F.when(st == "video", F.concat(task, F.lit("_merge"))).when(
        st == "ml", F.concat(task, F.lit("_aggregate"))).when(st == "financial", F.concat(task, F.lit("_risk_aggregate")))
    return first, last


def dag_dependencies(subtasks: DataFrame, edge_df: DataFrame | None = None) -> DataFrame:
    """Sorted sources of the in-edges of each subtask (empty when none).

    By default from the rows themselves: one scan and one shuffle by task. A task's subtasks are bounded
    by the strategy (at most 16 chunks, two stages and audio), so the collected lists are small.
    With ``edge_df`` (task_id, src, dst) the edges given are joined.
    """
    none = F.array().cast("array<string>")
    if edge_df is not None:
        deps = edge_df.groupBy("task_id", F.col("dst").alias("subtask_id")).agg(
            F.array_sort(F.collect_list("src")).alias("dependencies"))
        return subtasks.join(deps, ["task_id", "subtask_id"], "left").withColumn(
            "dependencies", F.coalesce("dependencies", none))
    sid, st = F.col("subtask_id"), F.col("strategy")
    first, last = _stage_ids()
    into_last = ((st == "video") & (sid != last)) | (st.isin("ml", "financial") & F.col("chunk").isNotNull())
    sources = F.array_sort(F.collect_list(F.when(into_last, sid)).over(Window.partitionBy("task_id")))
    return subtasks.withColumn("dependencies", F.when(sid == last, sources).when(
        st.isin("ml", "financial") & F.col("chunk").isNotNull(), F.array(first)).otherwise(none))


def queue_mapping(subtasks: DataFrame) -> DataFrame:
    """Target queue by category (default cpu_queue), batching eligibility
    (not I/O), flow-control priority and estimated completion (weight x 0.1)."""
    return subtasks.select(
        "*", _lookup(R.QUEUE_MAPPING, F.col("category"), R.DEFAULT_QUEUE).alias("target_queue"),
        (F.col("category") != "io_tasks").alias("batching_eligible"),
        F.col("priority").alias("flow_control_priority"),
        (F.col("weight") * F.lit(R.ESTIMATE_FACTOR)).alias("estimated_time"))


def dag_metrics(subtasks: DataFrame) -> DataFrame:
    """A12 per task: critical-path weight = sum of weights (D12), speed-up =
    sum(w) / max(sum(w / category speed-up), 1); the generic DAG has fixed 2.0 / 1.0."""
    sp = _lookup(R.CATEGORY_SPEEDUP, F.col("category"), 1.0)
    agg = subtasks.groupBy("task_id", "strategy").agg(
        F.sum("weight").alias("total_weight"), F.sum(F.col("weight") / sp).alias("parallel_weight"),
        F.count(F.lit(1)).alias("n_subtasks"))
    speedup = F.when(F.col("strategy") == "generic", F.lit(1.0)).when(
        F.col("parallel_weight") > 0, F.col("total_weight") / F.greatest(F.col("parallel_weight"), F.lit(1.0))
    ).otherwise(F.lit(1.0))
    return agg.select("task_id", "strategy", "n_subtasks", F.col("total_weight").alias("critical_path_weight"),
                      speedup.alias("estimated_speedup"))


# --- task-type detection (T1, J8, J11) ---------------------------------------

def length_band(keyword: str, threshold: float, method: str) -> tuple[int, int]:
    """The word lengths that can reach the threshold.

    Levenshtein: 1 - d/max >= t needs min/max >= t. Ratcliff: 2M/(la+lb) >= t with
    M <= min needs max <= (2 - t)/t x min.
    """
    ratio = threshold if method == "levenshtein" else threshold / (2 - threshold)
    return max(math.ceil(ratio * len(keyword) - 1e-9), 1), math.floor(len(keyword) / ratio + 1e-9)


def best_ratcliff(words: Column, keywords: list[str], bands: list[tuple[int, int]]) -> Column:
    """For each keyword the best difflib SequenceMatcher(None, keyword, word).ratio() of the words in its length band
    (null: none there). Each distinct word of a task is compared once (a bounded memo)."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import difflib

        memo: dict[str, list[tuple[int, float]]] = {}
        for batch in batches:
            out = []
            for row in batch:
                found: list[float | None] = [None] * len(keywords)
                for word in () if row is None else row:
                    got = memo.get(word)
                    if got is None:
                        got = [(i, difflib.SequenceMatcher(None, k, word).ratio())
                               for i, (k, (lo, hi)) in enumerate(zip(keywords, bands)) if lo <= len(word) <= hi]
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[word] = got
                    for i, r in got:
                        if found[i] is None or r > found[i]:
                            found[i] = r
                out.append(found)
            yield pd.Series(out, dtype=object)

    return best(words)


def fuzzy_keyword_scores(tasks: DataFrame, id_col: str, text_col: str, keywords=R.TASK_KEYWORDS,
                         threshold: float = R.SIMILARITY_THRESHOLD, method: str = "levenshtein") -> DataFrame:
    """J8 (Levenshtein form): for each type, sum over its keywords of the best
    word similarity when >= threshold, divided by the keyword count. A type none of whose
    keywords has a word of a length that can reach the threshold gives no row.

    similarity = 1 - levenshtein / max(len) by default; ``method="ratcliff"``
    uses difflib's ratio (keyword, word) as the original does, in an Arrow UDF.
    Each row's words are compared inside the scan with the keywords whose length band admits them; the shuffle
    carries one number a keyword and id. No word is a join key, so common words gather no rows.
    """
    if method not in ("levenshtein", "ratcliff"):
        raise ValueError(method)
    kws = list(dict.fromkeys(k for ks in keywords.values() for k in ks))
    bands = [length_band(k, threshold, method) for k in kws]
    rows = tasks.select(id_col, F.array_distinct(F.split(F.lower(F.col(text_col)), r"\s+")).alias("_words"))
    if method == "levenshtein":
        def best(k: str, lo: int, hi: int) -> Column:
            fit = F.filter("_words", lambda w: F.length(w).between(lo, hi))
            return F.array_max(F.transform(fit, lambda w: F.lit(1.0) - F.levenshtein(w, F.lit(k)) /
                                           F.greatest(F.length(w), F.lit(len(k))).cast("double")))
        rows = rows.select(id_col, *[best(k, *band).alias(f"_k{i}") for i, (k, band) in enumerate(zip(kws, bands))])
    else:
        rows = rows.select(id_col, best_ratcliff(F.col("_words"), kws, bands).alias("_best"))
        rows = rows.select(id_col, *[F.col("_best")[i].alias(f"_k{i}") for i in range(len(kws))])
    # rows of one id count together: the best of each
    per_id = rows.groupBy(id_col).agg(*[F.max(f"_k{i}").alias(f"_k{i}") for i in range(len(kws))])
    scores = []
    for ty, ks in keywords.items():
        if not ks:
            continue
        of = [F.col(f"_k{kws.index(k)}") for k in dict.fromkeys(ks)]
        total = F.lit(0.0)
        for c in of:
            total = total + F.when(c >= threshold, c).otherwise(0.0)
        scores.append(F.when(F.coalesce(*of).isNotNull(), F.struct(
            F.lit(ty).alias("task_type"), (total / F.lit(len(ks))).alias("keyword_score"))))
    return per_id.select(id_col, F.explode(F.array_compact(F.array(*scores))).alias("_s")).select(id_col, "_s.*")


def detect_type(tasks: DataFrame, keyword_scores: DataFrame, id_col: str, keywords=R.TASK_KEYWORDS,
                indicators=None, hierarchy=None, text_col: str | None = None,
                params_col: str | None = None) -> DataFrame:
    """score(type) = keyword score + 0.1 per indicator present + 0.2 if a
    hierarchy parent term occurs in the text (J11); the strictly greatest
    score wins in declared order, else ``generic``; confidence = min(.95, score).

    ``indicators`` maps type -> parameter names. With ``params_col`` (a
    map<string,string>) a name counts when it is a key of the map; without it
    every listed name counts (column-shaped parameters). A task's types are scored in its own
    row, one column each; rows of one id count together.
    """
    types = list(keywords)
    indicators = indicators or {}
    hierarchy = hierarchy or {}
    per_id = keyword_scores.groupBy(id_col).agg(*[
        F.max(F.when(F.col("task_type") == t, F.col("keyword_score"))).alias(f"_k{i}") for i, t in enumerate(types)])

    def bonus(t: str) -> Column:
        given = indicators.get(t, [])
        if not params_col:
            return F.lit(R.INDICATOR_BONUS * len(given))
        out = F.lit(0.0)
        for name in given:
            out = out + F.when(F.map_contains_key(F.col(params_col), F.lit(name)), 0.1).otherwise(0.0)
        return out

    def parent(t: str) -> Column:
        cond = F.lit(False)
        for term in hierarchy.get(t, []) if text_col else []:
            cond = cond | F.contains(F.lower(F.col(text_col)), F.lit(term))
        return F.when(cond, F.lit(R.HIERARCHY_BONUS)).otherwise(0.0)

    best = tasks.join(per_id, id_col, "left").groupBy(id_col).agg(*[
        F.max(F.coalesce(f"_k{i}", F.lit(0.0)) + bonus(t) + parent(t)).alias(f"_s{i}") for i, t in enumerate(types)])
    winner = F.array_max(F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(-i).alias("rank"),
                                            F.lit(t).alias("task_type")) for i, t in enumerate(types)]))
    best = best.select(id_col, winner.alias("b"))
    return best.select(id_col, F.when(F.col("b.score") > 0, F.col("b.task_type")).otherwise(F.lit("generic"))
                       .alias("task_type"),
                       F.round(F.least(F.lit(R.MAX_CONFIDENCE), F.greatest(F.col("b.score"), F.lit(0.0))), 6)
                       .alias("confidence"))


# --- registries (U2) ----------------------------------------------------------

STRATEGIES = {"video": "video", "ml": "ml", "financial": "financial", "image": "video", "database": "financial"}


def strategy_for(task_type: str) -> str:
    """Strategy name for a task type; unknown types use the generic DAG."""
    return STRATEGIES.get(task_type, "generic")
