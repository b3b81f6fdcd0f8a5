"""Task decomposition queries over `orders` (T1-T6, W13, W14, J4, J5, A12,
X17-X20) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.operators import dag as DG
from corpusloom.operators import tasks as TK
from corpusloom.plans import sqlgen as S
from corpusloom.plans.bindings import TASK_NOTES_SQL, TASK_PARAMS_SQL, task_notes, task_params
from corpusloom.plans.registry import register
from corpusloom.session import read_table, spread


def _case(expr, mapping, default):
    arms = " ".join(f"WHEN {S.lit(k)} THEN {v!r}" if not isinstance(v, str) else f"WHEN {S.lit(k)} THEN {S.lit(v)}"
                    for k, v in mapping.items())
    d = S.lit(default) if isinstance(default, str) else repr(default)
    return f"(CASE {expr} {arms} ELSE {d} END)"


def _chunks(items, mult, res):
    return (f"greatest(CAST(trunc(least(CAST(least(16, {res}) AS DOUBLE), greatest(1.0, floor(CAST({items} AS DOUBLE) "
            f"* {mult} / 10.0))) * 0.8) AS INTEGER), 1)")


_SUB_SQL = f"""WITH p AS ({TASK_PARAMS_SQL}),
s AS (SELECT *, {_case('task_type', R.STRATEGY_ROUTES, 'generic')} AS strategy,
  {_case('resolution', R.RESOLUTION_MULTIPLIERS, 1.0)} AS rm,
  {_case('model_type', R.MODEL_MULTIPLIERS, 1.0)} AS mm,
  {_case('calculation_type', R.CALCULATION_MULTIPLIERS, 1.0)} AS cm,
  CAST(ceil(data_size / batch_size) AS BIGINT) AS nb FROM p),
c AS (SELECT *, {_chunks('frame_count', 'rm', 'available_gpus')} AS vch,
  {_chunks('nb', 'mm', 'available_gpus')} AS mch, {_chunks('portfolio_size', 'cm', 'available_cpus')} AS fch FROM s),
vc AS (SELECT task_id, strategy, rm, frame_count AS total, vch AS n, unnest(range(vch)) AS i FROM c WHERE strategy = 'video'),
mc AS (SELECT task_id, strategy, mm, nb AS total, mch AS n, unnest(range(mch)) AS i FROM c WHERE strategy = 'ml'),
fc AS (SELECT task_id, strategy, cm, portfolio_size AS total, fch AS n, unnest(range(fch)) AS i FROM c WHERE strategy = 'financial'),
vr AS (SELECT *, i * greatest(1, total // n) AS st,
  CASE WHEN i = n - 1 THEN greatest(least((i + 1) * greatest(1, total // n), total), total)
       ELSE least((i + 1) * greatest(1, total // n), total) END AS en FROM vc),
mr AS (SELECT *, i * greatest(1, total // n) AS st,
  CASE WHEN i = n - 1 THEN greatest(least((i + 1) * greatest(1, total // n), total), total)
       ELSE least((i + 1) * greatest(1, total // n), total) END AS en FROM mc),
fr AS (SELECT *, i * greatest(1, total // n) AS st,
  CASE WHEN i = n - 1 THEN greatest(least((i + 1) * greatest(1, total // n), total), total)
       ELSE least((i + 1) * greatest(1, total // n), total) END AS en FROM fc),
sub AS (
  SELECT CAST(task_id AS VARCHAR) AS task_id, 'video' AS strategy, task_id || '_frame_chunk_' || i AS subtask_id,
    'Process Frames ' || st || '-' || en AS name, 'gpu_tasks' AS category, CAST(((en - st) * rm) * 0.8 AS DOUBLE) AS weight,
    3 AS priority, CAST(i AS INTEGER) AS chunk FROM vr
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'video', task_id || '_audio', 'Process Audio', 'cpu_tasks', 1.5, 2, NULL
    FROM c WHERE strategy = 'video' AND has_audio
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'video', task_id || '_merge', 'Merge Video Stream', 'io_tasks', 2.0 * rm, 3, NULL
    FROM c WHERE strategy = 'video'
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'ml', task_id || '_data_prep', 'Prepare Data Pipeline', 'io_tasks', 2.0 * mm, 3, NULL
    FROM c WHERE strategy = 'ml'
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'ml', task_id || '_inference_group_' || i, 'Inference Group ' || i, 'gpu_tasks',
    (3.0 * mm) * (en - st), 2, CAST(i AS INTEGER) FROM mr
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'ml', task_id || '_aggregate', 'Aggregate Results', 'cpu_tasks', 1.0 * mm, 2, NULL
    FROM c WHERE strategy = 'ml'
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'financial', task_id || '_market_data', 'Fetch Market Data', 'io_tasks', 2.0, 3, NULL
    FROM c WHERE strategy = 'financial'
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'financial', task_id || '_calc_' || i, 'Calculate Portfolio Segment ' || (i + 1),
    'cpu_tasks', (3.0 * cm) * ((en - st) / total), 2, CAST(i AS INTEGER) FROM fr
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'financial', task_id || '_risk_aggregate', 'Aggregate Risk Metrics', 'cpu_tasks',
    1.5 * cm, 3, NULL FROM c WHERE strategy = 'financial'
  UNION ALL SELECT CAST(task_id AS VARCHAR), 'generic', task_id || '_generic', 'Generic Task Processing', 'cpu_tasks', 2.0, 2, NULL
    FROM c WHERE strategy = 'generic')"""

_SUB_COLS = "task_id, strategy, subtask_id, name, category, round(weight, 9) AS weight, priority, chunk"


def subtasks(spark, sf):
    return TK.decompose(task_params(spark, sf))


def _out(df):
    return df.select("task_id", "strategy", "subtask_id", "name", "category", F.round("weight", 9).alias("weight"),
                     "priority", "chunk")


@register("decompose_tasks", _SUB_SQL + f" SELECT {_SUB_COLS} FROM sub")
def decompose_tasks(spark, sf):
    """Strategy routing over every task (union of T2-T5)."""
    return _out(subtasks(spark, sf))


for _strat in ("video", "ml", "financial", "generic"):
    def _mk(strat):
        def q(spark, sf):
            return _out(subtasks(spark, sf).filter(F.col("strategy") == strat))
        q.__name__ = f"decompose_{strat}"
        return q
    register(f"decompose_{_strat}", _SUB_SQL + f" SELECT {_SUB_COLS} FROM sub WHERE strategy = '{_strat}'")(_mk(_strat))


@register("adaptive_chunks", _SUB_SQL + """
SELECT task_id, strategy, CASE strategy WHEN 'video' THEN vch WHEN 'ml' THEN mch WHEN 'financial' THEN fch END AS chunks
FROM c WHERE strategy <> 'generic'""")
def adaptive_chunks(spark, sf):
    p = task_params(spark, sf)
    strat = TK._lookup(R.STRATEGY_ROUTES, F.col("task_type"), "generic")
    rm = TK._lookup(R.RESOLUTION_MULTIPLIERS, F.col("resolution"), 1.0)
    mm = TK._lookup(R.MODEL_MULTIPLIERS, F.col("model_type"), 1.0)
    cm = TK._lookup(R.CALCULATION_MULTIPLIERS, F.col("calculation_type"), 1.0)
    nb = F.ceil(F.col("data_size") / F.col("batch_size")).cast("long")
    ch = (F.when(strat == "video", TK.adaptive_chunks(F.col("frame_count"), rm, F.col("available_gpus")))
          .when(strat == "ml", TK.adaptive_chunks(nb, mm, F.col("available_gpus")))
          .when(strat == "financial", TK.adaptive_chunks(F.col("portfolio_size"), cm, F.col("available_cpus"))))
    return p.select("task_id", strat.alias("strategy"), ch.alias("chunks")).filter(F.col("strategy") != "generic")


@register("range_chunks", _SUB_SQL + """
SELECT task_id, strategy, CAST(i AS INTEGER) AS chunk, st AS start_item, en AS end_item FROM
  (SELECT task_id, strategy, i, st, en FROM vr UNION ALL SELECT task_id, strategy, i, st, en FROM mr
   UNION ALL SELECT task_id, strategy, i, st, en FROM fr)""")
def range_chunks(spark, sf):
    p = task_params(spark, sf)
    strat = TK._lookup(R.STRATEGY_ROUTES, F.col("task_type"), "generic")
    rm = TK._lookup(R.RESOLUTION_MULTIPLIERS, F.col("resolution"), 1.0)
    mm = TK._lookup(R.MODEL_MULTIPLIERS, F.col("model_type"), 1.0)
    cm = TK._lookup(R.CALCULATION_MULTIPLIERS, F.col("calculation_type"), 1.0)
    nb = F.ceil(F.col("data_size") / F.col("batch_size")).cast("long")
    total = (F.when(strat == "video", F.col("frame_count")).when(strat == "ml", nb)
             .when(strat == "financial", F.col("portfolio_size")))
    ch = (F.when(strat == "video", TK.adaptive_chunks(F.col("frame_count"), rm, F.col("available_gpus")))
          .when(strat == "ml", TK.adaptive_chunks(nb, mm, F.col("available_gpus")))
          .when(strat == "financial", TK.adaptive_chunks(F.col("portfolio_size"), cm, F.col("available_cpus"))))
    x = p.select("task_id", strat.alias("strategy"), total.alias("total"), ch.alias("n")).filter(
        F.col("strategy") != "generic")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    s, e = TK.range_chunk(F.col("chunk"), F.col("n"), F.col("total"))
    return x.select("task_id", "strategy", "chunk", s.alias("start_item"), e.alias("end_item"))


_EDGES_SQL = """,
edges AS (
  SELECT task_id, subtask_id AS src, task_id || '_merge' AS dst FROM sub WHERE strategy = 'video' AND subtask_id NOT LIKE '%\\_merge' ESCAPE '\\'
  UNION ALL SELECT task_id, task_id || '_data_prep', subtask_id FROM sub WHERE strategy = 'ml' AND chunk IS NOT NULL
  UNION ALL SELECT task_id, subtask_id, task_id || '_aggregate' FROM sub WHERE strategy = 'ml' AND chunk IS NOT NULL
  UNION ALL SELECT task_id, task_id || '_market_data', subtask_id FROM sub WHERE strategy = 'financial' AND chunk IS NOT NULL
  UNION ALL SELECT task_id, subtask_id, task_id || '_risk_aggregate' FROM sub WHERE strategy = 'financial' AND chunk IS NOT NULL)"""


@register("dag_dependencies", _SUB_SQL + _EDGES_SQL + """
SELECT s.task_id, s.subtask_id, coalesce(array_to_string(list_sort(d.deps), ','), '') AS dependencies
FROM sub s LEFT JOIN (SELECT task_id, dst AS subtask_id, list(src) AS deps FROM edges GROUP BY ALL) d
USING (task_id, subtask_id)""")
def dag_dependencies(spark, sf):
    sub = subtasks(spark, sf)
    d = TK.dag_dependencies(sub)
    return d.select("task_id", "subtask_id", F.array_join("dependencies", ",").alias("dependencies"))


@register("queue_mapping", _SUB_SQL + f"""
SELECT subtask_id, {_case('category', R.QUEUE_MAPPING, R.DEFAULT_QUEUE)} AS target_queue,
  category <> 'io_tasks' AS batching_eligible, priority AS flow_control_priority,
  round(weight * 0.1, 9) AS estimated_time FROM sub""")
def queue_mapping(spark, sf):
    m = TK.queue_mapping(subtasks(spark, sf))
    return m.select("subtask_id", "target_queue", "batching_eligible", "flow_control_priority",
                    F.round("estimated_time", 9).alias("estimated_time"))


@register("dag_speedup", _SUB_SQL + f"""
SELECT task_id, strategy, count(*) AS n_subtasks, round(sum(weight), 6) AS critical_path_weight,
  round(CASE WHEN strategy = 'generic' THEN 1.0
    WHEN sum(weight / {_case('category', R.CATEGORY_SPEEDUP, 1.0)}) > 0
    THEN sum(weight) / greatest(sum(weight / {_case('category', R.CATEGORY_SPEEDUP, 1.0)}), 1.0) ELSE 1.0 END, 6)
  AS estimated_speedup FROM sub GROUP BY task_id, strategy""")
def dag_speedup(spark, sf):
    m = TK.dag_metrics(subtasks(spark, sf))
    return m.select("task_id", "strategy", "n_subtasks", F.round("critical_path_weight", 6).alias("critical_path_weight"),
                    F.round("estimated_speedup", 6).alias("estimated_speedup"))


@register("dag_critical_path", _SUB_SQL.replace("WITH p", "WITH RECURSIVE p", 1) + _EDGES_SQL + """,
chain AS (
  SELECT task_id, subtask_id, weight AS finish, 1::BIGINT AS hops FROM sub s
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = s.task_id AND e.dst = s.subtask_id)
  UNION ALL
  SELECT s.task_id, s.subtask_id, s.weight + c.finish, c.hops + 1 FROM chain c
  JOIN edges e ON e.task_id = c.task_id AND e.src = c.subtask_id
  JOIN sub s ON s.task_id = e.task_id AND s.subtask_id = e.dst),
best AS (SELECT task_id, max({'finish': finish, 'hops': hops}) AS b FROM chain GROUP BY task_id),
total AS (SELECT task_id, count(*) AS n_subtasks, sum(weight) AS total_weight FROM sub GROUP BY task_id)
SELECT task_id, round(b.finish, 6) AS critical_path_weight, b.hops AS critical_path_nodes, n_subtasks,
  round(total_weight, 6) AS total_weight FROM best JOIN total USING (task_id)""")
def dag_critical_path(spark, sf):
    """A11 over the stored DAGs: the heaviest chain of every task's subtasks."""
    sub = subtasks(spark, sf)
    p = DG.critical_paths(sub, TK.edges(sub))
    return p.select("task_id", F.round("critical_path_weight", 6).alias("critical_path_weight"), "critical_path_nodes",
                    "n_subtasks", F.round("total_weight", 6).alias("total_weight"))


# --- configuration formulas (X18, X19) and memo key (X17) ---------------------

@register("task_complexity", f"""WITH p AS ({TASK_PARAMS_SQL})
SELECT task_id, round(CASE
  WHEN task_type = 'video' THEN frame_count * {_case('resolution', R.VIDEO_RESOLUTION_FACTORS, 1)} * (available_gpus / 5)
  WHEN task_type = 'ml' THEN (data_size / batch_size) * pow(available_gpus / 100, 0.5)
  WHEN task_type = 'financial' THEN portfolio_size * pow(available_cpus, 0.8) * (frame_count / 252)
  WHEN task_type = 'image' THEN frame_count * pow(available_gpus / 1080, 1.5) * available_cpus END, 6) AS complexity
FROM p WHERE task_type IN ('video', 'ml', 'financial', 'image')""")
def task_complexity(spark, sf):
    """X18 formulas with order fields standing in for the named parameters."""
    p = task_params(spark, sf)
    vf = TK._lookup(R.VIDEO_RESOLUTION_FACTORS, F.col("resolution"), 1)
    t = F.col("task_type")
    val = (F.when(t == "video", F.col("frame_count") * vf * (F.col("available_gpus") / 5))
           .when(t == "ml", (F.col("data_size") / F.col("batch_size")) * F.pow(F.col("available_gpus") / 100, 0.5))
           .when(t == "financial", F.col("portfolio_size") * F.pow(F.col("available_cpus"), 0.8) *
                 (F.col("frame_count") / 252))
           .when(t == "image", F.col("frame_count") * F.pow(F.col("available_gpus") / 1080, 1.5) *
                 F.col("available_cpus")))
    return p.filter(t.isin("video", "ml", "financial", "image")).select("task_id", F.round(val, 6).alias("complexity"))


def _prio_sql():
    arms = " ".join(f"WHEN list_has_any(w, [{', '.join(S.lit(k) for k in kws)}]) THEN {S.lit(level)}"
                    for level, kws in R.PRIORITY_RULES)
    return f"(CASE {arms} ELSE {S.lit(R.DEFAULT_PRIORITY)} END)"


@register("keyword_priority", f"""SELECT task_id, {_prio_sql()} AS priority_level FROM
  (SELECT task_id, string_split_regex(lower(note), '[^a-z-]+') AS w FROM ({TASK_NOTES_SQL}))""")
def keyword_priority(spark, sf):
    """Whole-word keyword lists checked high, low, medium; default medium."""
    o = task_notes(spark, sf).select("task_id", F.split(F.lower("note"), "[^a-z-]+").alias("w"))
    out = None
    for level, kws in R.PRIORITY_RULES:
        cond = F.arrays_overlap("w", F.array(*[F.lit(k) for k in kws]))
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return o.select("task_id", out.otherwise(F.lit(R.DEFAULT_PRIORITY)).alias("priority_level"))


@register("memo_key", f"""WITH p AS ({TASK_PARAMS_SQL})
SELECT task_id, md5(CAST(task_id AS VARCHAR) || '_' || 'batch_size=' || CAST(batch_size AS VARCHAR) || ','
  || 'frame_count=' || CAST(frame_count AS VARCHAR) || ',' || 'resolution=' || resolution) AS memo_key FROM p""")
def memo_key(spark, sf):
    """md5 of parent + '_' + parameters sorted by name (our own k=v format)."""
    p = task_params(spark, sf)
    params = F.create_map(F.lit("resolution"), F.col("resolution"), F.lit("frame_count"),
                          F.col("frame_count").cast("string"), F.lit("batch_size"), F.col("batch_size").cast("string"))
    return p.select("task_id", memo_key_expr(F.col("task_id"), params).alias("memo_key"))


def memo_key_expr(parent, params):
    entries = F.array_sort(F.map_entries(params))
    body = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.md5(F.concat(parent.cast("string"), F.lit("_"), body))


# --- task-type detection (T1 with J8 Levenshtein) over part names -------------

_FIXTURE_TASK_KEYWORDS = {
    "video": ["ring", "frame", "video"],
    "ml": ["widget", "model", "gear"],
    "database": ["bolt", "table", "index"],
    "financial": ["blue", "price", "risk"],
    "image": ["red", "image", "filter"],
    "data_processing": ["small", "large", "data"],
}
_FIXTURE_TASK_INDICATORS = {"video": ["p_size"], "ml": ["p_brand"], "database": [], "financial": ["p_retailprice"],
                            "image": [], "data_processing": ["p_type"]}


# which parameters a part, as a task, comes with
_GIVEN = {"p_size": "p_size > 25", "p_brand": "p_brand LIKE '%1%'", "p_retailprice": "p_retailprice > 905",
          "p_type": "p_type LIKE 'S%'"}


def _typed_tasks(spark, sf):
    """Parts as tasks: description, and the map of the parameters given."""
    given = F.map_filter(F.create_map(*[x for name, cond in _GIVEN.items() for x in (
        F.lit(name), F.when(F.expr(cond), F.lit("given")))]), lambda k, v: v.isNotNull())
    return spread(read_table(spark, sf, "part")).select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("d"),
                                                        given.alias("params"))


def _detect_sql():
    import math
    rows = []
    for ty, kws in _FIXTURE_TASK_KEYWORDS.items():
        for k in kws:
            rows.append(f"({S.lit(ty)}, {S.lit(k)}, {len(kws)})")
    # a parameter is given to a task or not: its bonus depends on the row
    ind = " ".join(f"WHEN {S.lit(ty)} THEN 0.0 " + " ".join(f"+ CASE WHEN {_GIVEN[i]} THEN {R.INDICATOR_BONUS} ELSE 0.0 END" for i in v)
                   for ty, v in _FIXTURE_TASK_INDICATORS.items())
    hier = " ".join(f"WHEN {S.lit(ty)} THEN CASE WHEN {' OR '.join(f'contains(lower(d), {S.lit(t)})' for t in terms)} "
                    f"THEN {R.HIERARCHY_BONUS} ELSE 0.0 END" for ty, terms in R.FIXTURE_HIERARCHIES.items())
    order = ", ".join(S.lit(t) for t in _FIXTURE_TASK_KEYWORDS)
    del math
    return f"""WITH kw AS (SELECT * FROM (VALUES {", ".join(rows)}) v(task_type, keyword, n_keywords)),
words AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) AS word FROM part),
sim AS (SELECT w.p_partkey, k.task_type, k.keyword, k.n_keywords,
  max(1.0 - levenshtein(w.word, k.keyword) / CAST(greatest(length(w.word), length(k.keyword)) AS DOUBLE)) AS best
  FROM words w, kw k WHERE w.word <> '' GROUP BY ALL),
ks AS (SELECT p_partkey, task_type, sum(CASE WHEN best >= {R.SIMILARITY_THRESHOLD} THEN best ELSE 0 END) / max(n_keywords)
  AS kscore FROM sim GROUP BY ALL),
sc AS (SELECT p_partkey, task_type, kscore + (CASE task_type {ind} END) + (CASE task_type {hier} ELSE 0.0 END) AS score,
  list_position([{order}], task_type) AS rnk FROM ks JOIN (SELECT *, p_name || ' ' || p_type AS d FROM part) USING (p_partkey)),
best AS (SELECT p_partkey, task_type, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, rnk) AS rn
  FROM sc)
SELECT p.p_partkey, CASE WHEN b.score > 0 THEN b.task_type ELSE 'generic' END AS task_type,
  round(least({R.MAX_CONFIDENCE}, greatest(coalesce(b.score, 0), 0)), 6) AS confidence
FROM part p LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (p_partkey)"""


@register("detect_task_type", _detect_sql())
def detect_task_type(spark, sf):
    """Fuzzy keyword score + 0.1 per indicator present + hierarchy bonus;
    strictly greater wins in declared order; confidence = min(.95, score)."""
    part = _typed_tasks(spark, sf)
    ks = TK.fuzzy_keyword_scores(part, "p_partkey", "d", _FIXTURE_TASK_KEYWORDS)
    return TK.detect_type(part, ks, "p_partkey", _FIXTURE_TASK_KEYWORDS, _FIXTURE_TASK_INDICATORS,
                          R.FIXTURE_HIERARCHIES, text_col="d", params_col="params")


# --- tagged training text (E6) and the fuzzy keyword score alone (J8) --------

def _stage_rank(sid: str):
    return (f"CASE WHEN {sid} LIKE '%\\_data\\_prep' ESCAPE '\\' OR {sid} LIKE '%\\_market\\_data' ESCAPE '\\' THEN 0 "
            f"WHEN chunk IS NOT NULL THEN 1 WHEN {sid} LIKE '%\\_audio' ESCAPE '\\' THEN 2 ELSE 3 END")


@register("training_text", _SUB_SQL + f""",
lines AS (SELECT task_id, strategy, {_stage_rank('subtask_id')} AS stage, coalesce(chunk, 0) AS ch,
  '- ' || name || ' (' || CAST(CAST(round(round(weight, 6) * 1000) AS BIGINT) AS VARCHAR) || 'mw, ' || category || ')' || chr(10)
  || CASE WHEN chunk IS NOT NULL THEN '  - chunk ' || CAST(chunk AS VARCHAR) || chr(10) ELSE '' END AS line FROM sub)
SELECT task_id, {S.hash16("chr(10) || '<TASK_DECOMPOSITION>' || chr(10) || 'Task ' || task_id || ' (' || strategy || ')' || chr(10) || chr(10) || 'Subtasks:' || chr(10) || body || chr(10) || '</TASK_DECOMPOSITION>' || chr(10) || chr(10) || '<IMPLEMENTATION>' || chr(10) || 'strategy=' || strategy || chr(10) || '</IMPLEMENTATION>' || chr(10) || chr(10) || '<CATEGORY>' || strategy || '</CATEGORY>' || chr(10)")} AS text_hash,
  CAST(n AS INTEGER) AS n_lines FROM (SELECT task_id, strategy, string_agg(line, '' ORDER BY stage, ch) AS body,
  count(*) AS n FROM lines GROUP BY task_id, strategy)""")
def training_text(spark, sf):
    """Description, two-level bullet list of subtasks, implementation and
    category tags; lines are ordered per task (bounded by the strategy)."""
    from corpusloom.functions.text import hash16
    sub = subtasks(spark, sf)
    sid = F.col("subtask_id")
    stage = (F.when(sid.endswith("_data_prep") | sid.endswith("_market_data"), 0)
             .when(F.col("chunk").isNotNull(), 1).when(sid.endswith("_audio"), 2).otherwise(3))
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.round(F.round("weight", 6) * 1000).cast("long").cast("string"),
                    F.lit("mw, "), "category", F.lit(")\n"),
                    F.when(F.col("chunk").isNotNull(), F.concat(F.lit("  - chunk "), F.col("chunk").cast("string"),
                                                               F.lit("\n"))).otherwise(F.lit("")))
    per = sub.select("task_id", "strategy", stage.alias("stage"), F.coalesce("chunk", F.lit(0)).alias("ch"),
                     line.alias("line"))
    g = per.groupBy("task_id", "strategy").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "ch", "line"))), lambda x: x["line"]),
                     "").alias("body"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("\n<TASK_DECOMPOSITION>\nTask "), F.col("task_id"), F.lit(" ("), F.col("strategy"),
                    F.lit(")\n\nSubtasks:\n"), F.col("body"), F.lit("\n</TASK_DECOMPOSITION>\n\n<IMPLEMENTATION>\n"),
                    F.lit("strategy="), F.col("strategy"), F.lit("\n</IMPLEMENTATION>\n\n<CATEGORY>"), F.col("strategy"),
                    F.lit("</CATEGORY>\n"))
    return g.select("task_id", hash16(text).alias("text_hash"), F.col("n").cast("int").alias("n_lines"))


def _fuzzy_sql():
    rows = []
    for ty, kws in _FIXTURE_TASK_KEYWORDS.items():
        for k in kws:
            rows.append(f"({S.lit(ty)}, {S.lit(k)}, {len(kws)})")
    return f"""WITH kw AS (SELECT * FROM (VALUES {", ".join(rows)}) v(task_type, keyword, n_keywords)),
words AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) AS word FROM part),
sim AS (SELECT w.p_partkey, k.task_type, k.keyword, k.n_keywords,
  max(1.0 - levenshtein(w.word, k.keyword) / CAST(greatest(length(w.word), length(k.keyword)) AS DOUBLE)) AS best
  FROM words w, kw k WHERE w.word <> '' GROUP BY ALL)
SELECT p_partkey, task_type, round(sum(CASE WHEN best >= {R.SIMILARITY_THRESHOLD} THEN best ELSE 0 END) / max(n_keywords), 6)
  AS keyword_score FROM sim GROUP BY ALL HAVING sum(CASE WHEN best >= {R.SIMILARITY_THRESHOLD} THEN best ELSE 0 END) > 0"""


@register("fuzzy_keyword_score", _fuzzy_sql())
def fuzzy_keyword_score(spark, sf):
    """J8 (Levenshtein similarity, threshold 0.8): non-zero scores per (part, type)."""
    part = spread(read_table(spark, sf, "part")).select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("d"))
    ks = TK.fuzzy_keyword_scores(part, "p_partkey", "d", _FIXTURE_TASK_KEYWORDS)
    return ks.filter(F.col("keyword_score") > 0).select("p_partkey", "task_type",
                                                         F.round("keyword_score", 6).alias("keyword_score"))


@register("detect_task_type_ratcliff")
def detect_task_type_ratcliff(spark, sf):
    """T1 with the original's difflib (Ratcliff/Obershelp) word similarity in
    an Arrow UDF over the length-banded (word, keyword) pairs (rows-only check;
    the SURVEY §5 goldens are reproduced in pytest)."""
    part = spread(read_table(spark, sf, "part")).select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("d"))
    ks = TK.fuzzy_keyword_scores(part, "p_partkey", "d", _FIXTURE_TASK_KEYWORDS, method="ratcliff")
    return TK.detect_type(part.select("p_partkey"), ks, "p_partkey", _FIXTURE_TASK_KEYWORDS, _FIXTURE_TASK_INDICATORS)
