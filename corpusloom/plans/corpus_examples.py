"""Example construction, curation and statistics queries (E1-E5, J1, X11,
A1-A11, W2-W5, M1, M4, E7) over `documents`, `labels` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import curate, examples, stats
from corpusloom.operators import pages as P
from corpusloom.plans import sqlgen as S
from corpusloom.plans.bindings import code_files
from corpusloom.plans.corpus import _DEDUPED
from corpusloom.plans.registry import register
from corpusloom.session import materialized, read_table, small_batches

FP, FD, FT = R.FIXTURE_CATEGORY_PATTERNS, R.FIXTURE_DEFAULT_CATEGORY, R.FIXTURE_STEP_TEMPLATES
SEED = "timing"


def code_examples(spark, sf, compat=False):
    return examples.build_code_examples(
        code_files(spark, sf), patterns=FP, default=FD, context_rules=R.FIXTURE_CONTEXT_RULES,
        templates=FT, seed=SEED, compat=compat)


def _ex_sql(compat=False) -> str:
    """CTEs up to `st` (one row per example step with its drawn microseconds) and `cp`."""
    ctx = S.categorize_context("content", "file_path", "repo", FP, FD, R.FIXTURE_CONTEXT_RULES)
    score = S.complexity_score("content", R.COMPLEXITY_INDICATORS)
    lo, hi = S.timing_bounds("t.resource", "t.criticality", "k.score / 5.0")
    draw = S.seeded_draw(SEED, "k.doc_id", "t.step")
    cats = ", ".join(S.lit(c) for c in FT)
    return _DEDUPED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ex AS (SELECT doc_id, repo, file_path, content, {ctx} AS category, {score} AS score FROM deduped),
tpl AS {S.template_values(FT, compat)},
keyed AS (SELECT *, CASE WHEN category IN ({cats}) THEN category ELSE '__generic__' END AS tkey FROM ex),
st0 AS (SELECT k.doc_id, k.category, k.score, t.step, t.action, t.resource, t.criticality, t.par, t.deps,
          {lo} AS lo, {hi} AS hi, {draw} AS draw FROM keyed k JOIN tpl t ON t.category = k.tkey),
st AS (SELECT *, lo + (draw % (hi - lo + 1)) AS us FROM st0),
{S.critical_path_cte('st', 'doc_id', 'ex')},
cpath AS (SELECT doc_id, max(list_max(fin)) AS critical_path_us FROM cp GROUP BY doc_id),
agg AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_steps, CAST(sum(us) AS BIGINT) AS total_us,
          coalesce(string_agg(CASE WHEN par THEN CAST(step AS VARCHAR) END, ',' ORDER BY step), '') AS parallel_steps
        FROM st GROUP BY doc_id)"""


_LEVEL = S.complexity_level("a.n_steps", "e.score")


@register("build_code_examples", _ex_sql() + f"""
SELECT e.doc_id, e.category, a.n_steps, a.total_us, c.critical_path_us, {_LEVEL} AS complexity,
  a.parallel_steps, 'Analyze and decompose this ' || e.category || ' code from a production repository' AS instruction
FROM ex e JOIN agg a USING (doc_id) JOIN cpath c USING (doc_id)""")
def build_code_examples(spark, sf):
    ex = code_examples(spark, sf)
    return ex.select("doc_id", "category", "n_steps", "total_us", "critical_path_us", "complexity",
                     F.array_join(F.transform("parallelizable_steps", lambda x: x.cast("string")), ",")
                     .alias("parallel_steps"), "instruction")


@register("template_expand", _ex_sql() + """
SELECT doc_id, step, action, resource, criticality FROM st""")
def template_expand(spark, sf):
    ex = code_examples(spark, sf)
    return examples.one_row_per_step(ex, "steps", "s", "doc_id").select(
        "doc_id", "s.step", "s.action", "s.resource", "s.criticality")


@register("step_timing", _ex_sql() + """
SELECT doc_id, step, lo AS min_us, hi AS max_us, us AS expected_us FROM st""")
def step_timing(spark, sf):
    ex = code_examples(spark, sf)
    base = F.col("complexity_score") / F.lit(5.0)
    s = examples.one_row_per_step(ex, "steps", "s", "doc_id", base.alias("base"))
    lo, hi = examples.timing_bounds(F.col("s.resource"), F.col("s.criticality"), F.col("base"))
    return s.select("doc_id", "s.step", lo.alias("min_us"), hi.alias("max_us"), F.col("s.expected_us"))


@register("step_totals", _ex_sql() + """
SELECT doc_id, n_steps, total_us, parallel_steps FROM agg""")
def step_totals(spark, sf):
    ex = code_examples(spark, sf)
    return ex.select("doc_id", "n_steps", "total_us", F.array_join(
        F.transform("parallelizable_steps", lambda x: x.cast("string")), ",").alias("parallel_steps"))


@register("critical_path", _ex_sql() + """
SELECT doc_id, critical_path_us FROM cpath""")
def critical_path(spark, sf):
    return code_examples(spark, sf).select("doc_id", "critical_path_us")


@register("critical_path_compat", _ex_sql(compat=True) + """
SELECT doc_id, critical_path_us FROM cpath""")
def critical_path_compat(spark, sf):
    """A11 with the original 0-based dependency lookup (D2 compat)."""
    return code_examples(spark, sf, compat=True).select("doc_id", "critical_path_us")


@register("resource_usage", _ex_sql() + """
SELECT resource, count(*) AS n FROM st GROUP BY resource""")
def resource_usage(spark, sf):
    ex = code_examples(spark, sf)
    return examples.one_row_per_step(ex, "steps", "s").select("s.resource").groupBy("resource").agg(
        F.count(F.lit(1)).alias("n"))


@register("category_breakdown", _ex_sql() + """
SELECT e.category, count(*) AS n, round(avg(a.n_steps), 9) AS avg_steps, round(avg(a.total_us), 6) AS avg_time_us
FROM ex e JOIN agg a USING (doc_id) GROUP BY e.category""")
def category_breakdown(spark, sf):
    ex = code_examples(spark, sf)
    return ex.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_steps"), 9).alias("avg_steps"),
                                      F.round(F.avg("total_us"), 6).alias("avg_time_us"))


@register("category_samples", _ex_sql() + f"""
SELECT category, doc_id, substr('Analyze and decompose this ' || category || ' code from a production repository', 1, 100)
  || '...' AS summary, complexity, n_steps, 'github' AS source FROM (SELECT e.category, e.doc_id, {_LEVEL} AS complexity,
  a.n_steps, row_number() OVER (PARTITION BY e.category ORDER BY e.doc_id) AS rn FROM ex e JOIN agg a USING (doc_id))
WHERE rn <= 5""")
def category_samples(spark, sf):
    ex = code_examples(spark, sf).select("category", "doc_id", "instruction", "complexity", "n_steps", "source")
    first = curate.first_k_per_group(ex, "category", ["doc_id"], 5)
    return first.select("category", "doc_id", T.truncate_chars(F.col("instruction"), 100).alias("summary"),
                        "complexity", "n_steps", "source")


@register("crosstab_complexity", _ex_sql() + f"""
SELECT e.category, {_LEVEL} AS complexity, count(*) AS n FROM ex e JOIN agg a USING (doc_id) GROUP BY ALL""")
def crosstab_complexity(spark, sf):
    return code_examples(spark, sf).groupBy("category", "complexity").agg(F.count(F.lit(1)).alias("n"))


@register("crosstab_source", _ex_sql() + """
SELECT e.category, d.source, count(*) AS n FROM ex e JOIN documents d USING (doc_id) GROUP BY ALL""")
def crosstab_source(spark, sf):
    ex = code_examples(spark, sf).select("doc_id", "category", F.col("repo").alias("source"))
    return ex.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))


@register("crosstab_resource", _ex_sql() + """
SELECT category, resource, count(*) AS n FROM st GROUP BY ALL""")
def crosstab_resource(spark, sf):
    ex = code_examples(spark, sf)
    return examples.one_row_per_step(ex, "steps", "s", "category").groupBy("category", F.col("s.resource").alias("resource")).agg(
        F.count(F.lit(1)).alias("n"))


@register("distribution_pct", _ex_sql() + """
SELECT category, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (SELECT category, count(*) AS n FROM ex GROUP BY ALL)""")
def distribution_pct(spark, sf):
    counts = code_examples(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return stats.share_of_total(counts, "category")


@register("dist_all", _ex_sql() + f"""
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(complexity) = 0 THEN 'complexity'
            WHEN grouping(repo) = 0 THEN 'repo' ELSE 'total' END AS dimension,
       coalesce(category, complexity, repo, 'all') AS value, count(*) AS n
FROM (SELECT e.category, {_LEVEL} AS complexity, e.repo FROM ex e JOIN agg a USING (doc_id))
GROUP BY GROUPING SETS ((category), (complexity), (repo), ())""")
def dist_all(spark, sf):
    ex = code_examples(spark, sf).select("category", "complexity", "repo")
    return stats.distributions(ex, ["category", "complexity", "repo"])


@register("json_target", _ex_sql() + """
SELECT doc_id, to_json({'operation': e.category, 'n_steps': a.n_steps, 'total_us': a.total_us,
  'complexity': """ + _LEVEL + """}) AS target FROM ex e JOIN agg a USING (doc_id)""")
def json_target(spark, sf):
    ex = code_examples(spark, sf)
    out = F.struct(F.col("category").alias("operation"), "n_steps", "total_us", "complexity")
    return ex.select("doc_id", examples.json_target(out).alias("target"))


@register("prompt_target", _ex_sql() + """
SELECT doc_id, 'Decompose ' || 'Analyze and decompose this ' || e.category || ' code from a production repository'
  AS prompt, to_json({'operation': e.category, 'total_us': a.total_us}) || '<|endoftext|>' AS target
FROM ex e JOIN agg a USING (doc_id)""")
def prompt_target(spark, sf):
    ex = code_examples(spark, sf)
    return ex.select("doc_id", F.concat(F.lit(R.PROMPT_PREFIX), "instruction").alias("prompt"),
                     F.concat(examples.json_target(F.struct(F.col("category").alias("operation"), "total_us")),
                              F.lit(R.END_TOKEN)).alias("target"))


# --- older builder (E5) ------------------------------------------------------

def _basic_sql():
    cat = S.first_match("text", R.FIXTURE_FIRST_MATCH_RULES, FD)
    return f"""WITH g AS (SELECT doc_id, source, lang, text, {cat} AS category FROM documents
  WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100)
SELECT doc_id, category, 'Decompose and analyze this ' || category || ' code' AS instruction,
  {S.hash16("'Repository: ' || source || chr(10) || 'File: ' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || chr(10) || 'Code:' || chr(10) || substr(text, 1, 1000) || '...'")} AS input_hash,
  CAST(1 AS INTEGER) AS n_steps, 50 + ({S.seeded_draw('basic', 'doc_id', '1')} % 451) AS first_ns FROM g"""


@register("build_examples_basic", _basic_sql())
def build_examples_basic(spark, sf):
    f = code_files(spark, sf).withColumnRenamed("content", "text")
    ex = examples.build_examples_basic(f, id_col="doc_id", text_col="text", repo_col="repo", path_col="file_path",
                                       rules=R.FIXTURE_FIRST_MATCH_RULES, default=FD)
    return ex.select("doc_id", "category", "instruction", T.hash16("input").alias("input_hash"),
                     F.size("steps").alias("n_steps"),
                     F.regexp_extract(F.col("steps")[0]["expected_time"], "^(\\d+)", 1).cast("long").alias("first_ns"))


# --- synthetic operations (E4): one per (source, operation) -------------------

def _synthetic_sql():
    rows = []
    for name, cat, level, tpl in R.SYNTHETIC_OPERATIONS:
        for i, (a, res, crit, _l, _h, _t, par, deps) in enumerate(tpl):
            rows.append(f"({S.lit(name)}, {S.lit(cat)}, {S.lit(level)}, {i + 1}, {S.lit(a)}, {S.lit(res)}, {S.lit(crit)}, "
                        f"{str(par).lower()}, {S._arr([d + 1 for d in deps])})")
    lo, hi = S.timing_bounds("t.resource", "t.criticality", "1.0")
    draw = S.seeded_draw("synthetic", "a.src || ':' || t.op", "t.step")
    return f"""WITH RECURSIVE a AS (SELECT DISTINCT source AS src FROM documents),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) v(op, category, complexity, step, action, resource, criticality, par, deps)),
st0 AS (SELECT a.src || '|' || t.op AS key, t.*, {lo} AS lo, {hi} AS hi, {draw} AS draw FROM a CROSS JOIN t),
st AS (SELECT *, lo + (draw % (hi - lo + 1)) AS us FROM st0),
anchor AS (SELECT DISTINCT key FROM st),
{S.critical_path_cte('st', 'key', 'anchor')}
SELECT split_part(key, '|', 1) AS source, split_part(key, '|', 2) AS operation, category, complexity,
  CAST(count(*) AS INTEGER) AS n_steps, CAST(sum(us) AS BIGINT) AS total_us,
  (SELECT max(list_max(fin)) FROM cp WHERE cp.key = st.key) AS critical_path_us
FROM st GROUP BY key, category, complexity"""


@register("build_synthetic_examples", _synthetic_sql())
def build_synthetic_examples(spark, sf):
    srcs = read_table(spark, sf, "documents").select(F.col("source").alias("src")).distinct()
    ops = F.array(*[F.lit(n) for n, _, _, _ in R.SYNTHETIC_OPERATIONS])
    anchor = srcs.select("src", F.explode(ops).alias("operation"))
    ex = examples.build_synthetic_examples(anchor, id_col="src", op_col="operation")
    return ex.select(F.col("src").alias("source"), "operation", "category", "complexity", "n_steps", "total_us", "critical_path_us")


# --- documentation and tutorial examples over `pages` (E2, E3, W1, J7) ---------

def page_items(spark, sf):
    """Pages as items: their paragraphs as blocks, their main headings as descriptions, one text per element."""
    sel = P.select_udf({"blocks": ["p"], "descriptions": ["h1"]})
    return small_batches(read_table(spark, sf, "pages")).select("page_id", "url", sel("html").alias("s")).select(
        "page_id", "url", F.col("s")["blocks"].alias("blocks"), F.col("s")["descriptions"].alias("descriptions"))


_ITEMS_SQL = f"""items AS (SELECT page_id, url, {S.html_elements('html', 'p')} AS blocks,
  {S.html_elements('html', 'h1')} AS descriptions FROM pages)"""


def _blocks_sql(n):
    return f"""WITH {_ITEMS_SQL},
ex AS (SELECT page_id, url, descriptions, unnest(blocks[1:{n}]) AS block,
  unnest(range(0, len(blocks[1:{n}]))) AS pos FROM items),
kept AS (SELECT * FROM ex WHERE length(regexp_replace(block, '^\\s+|\\s+$', '', 'g')) >= 50),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {S.hash16('block')}
  ORDER BY page_id, pos) AS rn FROM kept) WHERE rn = 1)"""


@register("build_doc_examples", _blocks_sql(3) + f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, {S.hash16("'Documentation source: ' || url || chr(10) || chr(10) || 'Code example:' || chr(10) || block")} AS input_hash,
  'reference_material' AS category, CAST(1200 AS BIGINT) AS total_us FROM dd""")
def build_doc_examples(spark, sf):
    ex = examples.build_block_examples(page_items(spark, sf), id_col="page_id", url_col="url", blocks_col="blocks",
                                       kind="documentation")
    return ex.select("page_id", "pos", T.hash16("input").alias("input_hash"), "category", "total_us")


@register("build_tutorial_examples", _blocks_sql(2) + f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, coalesce(descriptions[pos + 1], 'Tutorial example') AS description,
  {S.hash16("'Tutorial context: ' || coalesce(descriptions[pos + 1], 'Tutorial example') || chr(10) || chr(10) || 'Tutorial source: ' || url || chr(10) || chr(10) || 'Code example:' || chr(10) || block")} AS input_hash,
  'educational_breakdown' AS category, CAST(1650 AS BIGINT) AS total_us FROM dd""")
def build_tutorial_examples(spark, sf):
    ex = examples.build_block_examples(page_items(spark, sf), id_col="page_id", url_col="url", blocks_col="blocks",
                                       kind="tutorial", descriptions_col="descriptions")
    return ex.select("page_id", "pos", "description", T.hash16("input").alias("input_hash"), "category", "total_us")


@register("first_n_blocks", f"""WITH {_ITEMS_SQL}
SELECT page_id, CAST(len(blocks[1:3]) AS INTEGER) AS n_blocks FROM items""")
def first_n_blocks(spark, sf):
    return page_items(spark, sf).select("page_id", F.size(F.slice("blocks", 1, 3)).alias("n_blocks"))


@register("align_by_position", f"""WITH {_ITEMS_SQL}
SELECT page_id, CAST(pos AS INTEGER) AS pos, coalesce(descriptions[pos + 1], 'Tutorial example') AS description FROM
  (SELECT page_id, descriptions, unnest(range(0, len(blocks))) AS pos FROM items)""")
def align_by_position(spark, sf):
    it = page_items(spark, sf)
    ex = it.select("page_id", "descriptions", F.posexplode("blocks").alias("pos", "block"))
    return ex.select("page_id", "pos", F.coalesce(F.try_element_at("descriptions", F.col("pos") + 1),
                                                  F.lit("Tutorial example")).alias("description"))


# --- balancing over documents x labels (W2-W5) --------------------------------

def labelled(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    lab = read_table(spark, sf, "labels")
    j = d.join(lab, "doc_id")
    cat = F.concat_ws("_", "lang", F.concat(F.lit("q"), F.col("quality")), F.concat(F.lit("t"), F.col("toxic")))
    return j.select("doc_id", cat.alias("category"),
                    F.concat(F.lit("Analyze and decompose this "), cat, F.lit(" code from a production repository"))
                    .alias("instruction"))


_LAB_SQL = """lab AS (SELECT d.doc_id, d.lang || '_q' || CAST(l.quality AS VARCHAR) || '_t' || CAST(l.toxic AS VARCHAR)
  AS category FROM documents d JOIN labels l USING (doc_id)),
cnt AS (SELECT category, count(*) AS n FROM lab GROUP BY category)"""


def _draw(seed, *keys):
    return S.seeded_draw(seed, *keys)


_DOWN_SQL = f"""WITH {_LAB_SQL},
down AS (SELECT doc_id, category FROM (SELECT l.*, row_number() OVER (PARTITION BY l.category
  ORDER BY {_draw('balance', 'l.doc_id')}, l.doc_id) AS rn FROM lab l JOIN cnt c USING (category) WHERE c.n > 100)
  WHERE rn <= 100)"""

_VARS = ", ".join(S.lit(v) for v in R.INSTRUCTION_VARIATIONS)


def _replace_first_sql(expr, old, new):
    return (f"(CASE WHEN strpos({expr}, {S.lit(old)}) > 0 THEN substr({expr}, 1, strpos({expr}, {S.lit(old)}) - 1) "
            f"|| {new} || substr({expr}, strpos({expr}, {S.lit(old)}) + {len(old)}) ELSE {expr} END)")


def _up_instruction_sql():
    base = "('Analyze and decompose this ' || category || ' code from a production repository')"
    out = base
    for j, target in enumerate(R.VARIATION_TARGETS):
        pick = f"([{_VARS}])[1 + ({_draw('balance', S.lit(f'v{j}'), 'category', 'copy_no')} % 4)]"
        out = _replace_first_sql(out, target, pick)
    return out


_UP_SQL = f"""WITH {_LAB_SQL},
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.category ORDER BY l.doc_id) AS pos, c.n
  FROM lab l JOIN cnt c USING (category) WHERE c.n < 5),
need AS (SELECT category, n, unnest(range(1, 5 - n + 1)) AS copy_no FROM cnt WHERE n < 5),
picks AS (SELECT category, copy_no, 1 + ({_draw('balance', 'category', 'copy_no')} % n) AS pos FROM need),
up AS (SELECT r.doc_id, p.category, CAST(p.copy_no AS INTEGER) AS copy_no, {_up_instruction_sql()} AS instruction
  FROM picks p JOIN ranked r USING (category, pos))"""


@register("balance_down", _DOWN_SQL + " SELECT doc_id, category FROM down")
def balance_down(spark, sf):
    out = curate.balance_categories(labelled(spark, sf), "category", "doc_id", seed="balance",
                                    instruction_col="instruction")
    big = labelled(spark, sf).groupBy("category").count().filter(F.col("count") > R.MAX_PER_CATEGORY)
    # category counts are data-derived: no hint, AQE broadcasts at runtime when small
    return out.join(big.select("category"), "category").select("doc_id", "category")


@register("balance_up", _UP_SQL + " SELECT doc_id, category, copy_no, instruction FROM up")
def balance_up(spark, sf):
    out = curate.balance_categories(labelled(spark, sf), "category", "doc_id", seed="balance",
                                    instruction_col="instruction")
    return out.filter("variation").select("doc_id", "category", "copy_no", "instruction")


@register("balance_categories", _UP_SQL.replace("WITH ", "WITH ", 1) + f""",
down AS (SELECT doc_id, category FROM (SELECT l.*, row_number() OVER (PARTITION BY l.category
  ORDER BY {_draw('balance', 'l.doc_id')}, l.doc_id) AS rn FROM lab l JOIN cnt c USING (category) WHERE c.n > 100)
  WHERE rn <= 100)
SELECT category, count(*) AS n, CAST(sum(CASE WHEN variation THEN 1 ELSE 0 END) AS BIGINT) AS n_variations FROM (
  SELECT category, false AS variation FROM down
  UNION ALL SELECT l.category, false FROM lab l JOIN cnt c USING (category) WHERE c.n <= 100
  UNION ALL SELECT category, true FROM up) GROUP BY category""")
def balance_categories(spark, sf):
    out = curate.balance_categories(labelled(spark, sf), "category", "doc_id", seed="balance",
                                    instruction_col="instruction")
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.col("variation").cast("long")).alias("n_variations"))


@register("shuffle_seeded", """SELECT doc_id, md5('shuffle:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM documents""")
def shuffle_seeded(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return curate.shuffle_seeded(d, "doc_id", "shuffle")


# --- trace enrichment over events-as-traces (J2, J3) ---------------------------

_TRACE_CATS = ["english_prose", "german_prose", "french_prose", "spanish_prose", "unclassified"]


def traces(spark, sf):
    """`events` as execution traces: category from user_id, timing map from the event type."""
    e = read_table(spark, sf, "events")
    v = F.col("value")
    tm = (F.when(F.col("event_type") == "click", F.create_map(F.lit("connect"), v * 1e-4, F.lit("send"), v * 2e-4))
          .when(F.col("event_type") == "view", F.create_map(F.lit("socket"), v * 1e-4, F.lit("read"), v * 3e-4))
          .when(F.col("event_type") == "purchase", F.create_map(F.lit("write"), v * 1e-4, F.lit("recvfrom"), v * 1e-4))
          .when(F.col("event_type") == "signup", F.create_map(F.lit("getaddrinfo"), v * 1e-4))
          .otherwise(F.create_map().cast("map<string,double>")))
    cat = F.element_at(F.array(*[F.lit(c) for c in _TRACE_CATS]), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    return e.select(F.col("event_id").alias("trace_id"), cat.alias("category"), tm.alias("timing_data"))


_NAMES = [n for _, names in R.SYSCALL_MAPPINGS for n in names]
_TRACES_SQL = """traces AS (SELECT event_id AS trace_id,
  (['english_prose', 'german_prose', 'french_prose', 'spanish_prose', 'unclassified'])[user_id % 5 + 1] AS category,
  """ + ", ".join(
    f"CASE WHEN event_type = '{et}' THEN value * {mult} END AS t_{n}"
    for n, et, mult in [("connect", "click", "1e-4"), ("send", "click", "2e-4"), ("socket", "view", "1e-4"),
                        ("read", "view", "3e-4"), ("write", "purchase", "1e-4"), ("recvfrom", "purchase", "1e-4"),
                        ("getaddrinfo", "signup", "1e-4")]) + ", " + ", ".join(
    f"CAST(NULL AS DOUBLE) AS t_{n}" for n in ["sendto", "recv", "gethostbyname", "ssl_read", "ssl_write"]) + """
  FROM events),
tidx AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY trace_id) - 1 AS idx,
  count(*) OVER (PARTITION BY category) AS m FROM traces),
pick AS (SELECT e.doc_id, e.category, t.trace_id FROM ex e LEFT JOIN (SELECT DISTINCT category, m FROM tidx) c USING (category)
  LEFT JOIN tidx t ON t.category = e.category AND t.idx = """ + S.seeded_draw("trace", "e.doc_id") + """ % c.m)"""


@register("trace_enrich", _ex_sql() + ",\n" + _TRACES_SQL + """
SELECT doc_id, trace_id, trace_id IS NOT NULL AS trace_enhanced FROM pick""")
def trace_enrich(spark, sf):
    """One seeded-random trace of the example's category per example."""
    ex = code_examples(spark, sf).select("doc_id", "category", "steps")
    out = examples.enrich_with_traces(ex, traces(spark, sf), categories=_TRACE_CATS)
    return out.select("doc_id", "trace_id", "trace_enhanced")


def _match_sql():
    arms = " ".join(f"WHEN contains(lower(s.action), '{kw}') AND t.t_{n} IS NOT NULL THEN t.t_{n}"
                    for kw, names in R.SYSCALL_MAPPINGS for n in names)
    return f"CAST(trunc((CASE {arms} END) * 1000000) AS BIGINT)"


@register("syscall_timing_match", _ex_sql() + ",\n" + _TRACES_SQL + f""",
m AS (SELECT s.doc_id, s.step, s.us, {_match_sql()} AS real FROM st s JOIN pick p USING (doc_id)
  LEFT JOIN traces t ON t.trace_id = p.trace_id)
SELECT doc_id, step, CASE WHEN coalesce(real, 0) <> 0 THEN real ELSE us END AS expected_us,
  coalesce(real, 0) <> 0 AS matched FROM m""")
def syscall_timing_match(spark, sf):
    """Step timings replaced by the matching syscall timing of the picked trace."""
    ex = code_examples(spark, sf).select("doc_id", "category", "steps")
    out = examples.enrich_with_traces(ex, traces(spark, sf), categories=_TRACE_CATS)
    tm = F.coalesce(F.col("timing_data"), F.create_map().cast("map<string,double>"))
    new = out.select("doc_id", F.arrays_zip(F.col("steps"), examples.match_step_timing(F.col("steps"), tm)).alias("z"))
    z = examples.one_row_per_step(new, "z", "p", "doc_id")
    return z.select("doc_id", F.col("p.steps.step").alias("step"), F.col("p.1.expected_us").alias("expected_us"),
                    (F.col("p.1.expected_us") != F.col("p.steps.expected_us")).alias("matched"))


# --- union of generators, global dedupe, balance (O1, O2 on the union, W4, A5) --

_META = ("functions array<string>, classes array<string>, imports array<string>, lines_of_code int, "
         "complexity_score double, url string, description string, synthetic boolean")
UNION_COLUMNS = ["item_id", "source", "category", "instruction", "input", "operation", "output_category", "steps",
                 "n_steps", "total_us", "parallelizable_steps", "critical_path_us", "complexity", "metadata"]


def _metadata(**known):
    """The metadata struct of an example; what a generator doesn't know is null."""
    fields = [f.strip().split(" ", 1) for f in _META.split(",")]
    return F.struct(*[(known[n] if n in known else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _none_parallel():
    return F.array().cast("array<int>")


def _union_frames(spark, sf):
    """All generators' examples with the same columns: prompt, whole target and metadata."""
    # item ids are unique across generators: <source>:<local id>
    code = code_examples(spark, sf).withColumns({
        "item_id": F.concat_ws(":", F.lit("github"), F.col("doc_id").cast("string")), "output_category": F.col("category"),
        "metadata": _metadata(**{c: F.col(c) for c in ("functions", "classes", "imports", "lines_of_code",
                                                       "complexity_score")})})
    it = page_items(spark, sf)
    docs = examples.build_block_examples(it, id_col="page_id", url_col="url", blocks_col="blocks", kind="documentation")
    tuts = examples.build_block_examples(it, id_col="page_id", url_col="url", blocks_col="blocks",
                                         kind="tutorial", descriptions_col="descriptions")
    blocks = [x.withColumns({
        "item_id": F.concat_ws(":", "source", F.col("page_id").cast("string"), F.col("pos").cast("string")),
        "parallelizable_steps": _none_parallel(), "metadata": _metadata(url=F.col("url"), **more)})
        for x, more in ((docs, {}), (tuts, {"description": F.col("description")}))]
    srcs = read_table(spark, sf, "documents").select(F.col("source").alias("src")).distinct()
    ops = F.array(*[F.lit(n) for n, _, _, _ in R.SYNTHETIC_OPERATIONS])
    syn = examples.build_synthetic_examples(srcs.select("src", F.explode(ops).alias("op")), id_col="src", op_col="op")
    syn = syn.withColumns({"item_id": F.concat_ws(":", F.lit("synthetic"), "src", "operation"),
                           "output_category": F.col("category"), "metadata": _metadata(synthetic=F.lit(True))})
    frames = [x.select(UNION_COLUMNS) for x in (code, *blocks, syn)]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)        # schema drift between generators is an error
    return out


def _union_sql():
    syn_cats = ", ".join(f"('{c}')" for _, c, _, _ in R.SYNTHETIC_OPERATIONS)
    return f"""SELECT source, category, count(*) AS n FROM (
  SELECT 'github' AS source, category FROM ({_ex_sql()} SELECT category FROM ex)
  UNION ALL SELECT 'documentation', 'reference_material' FROM ({_blocks_sql(3)} SELECT 1 FROM dd)
  UNION ALL SELECT 'tutorial', 'educational_breakdown' FROM ({_blocks_sql(2)} SELECT 1 FROM dd)
  UNION ALL SELECT 'synthetic', c FROM (SELECT DISTINCT source FROM documents), (VALUES {syn_cats}) v(c)
) GROUP BY ALL"""


@register("union_sources", _union_sql())
def union_sources(spark, sf):
    """O1: code + documentation + tutorial + synthetic examples in one frame (counts per source, category)."""
    return _union_frames(spark, sf).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


def _source_hash():
    return T.hash16(F.concat_ws("\x1f", "instruction", "input"))


def balanced_set(spark, sf):
    """Union -> one global dedupe on (instruction, input) (D1, D15) -> balance per category.

    The union is written once, narrow decisions and the join that carries them out read that table.
    """
    u = materialized(_union_frames(spark, sf), "examples")
    u = curate.exact_dedupe(u, "input", ["source", "item_id"], keep_hash=False,
                            key=curate.text_key(F.concat_ws("\x1f", "instruction", "input")))
    bal = curate.balance_categories(u, "category", "item_id", instruction_col="instruction")
    # The hash follows the (possibly reworded) instruction of each row
    return bal.withColumn("source_hash", _source_hash()).withColumn(
        "row_key", F.concat_ws(":", "item_id", F.col("copy_no").cast("string")))


def training_set(spark, sf):
    """The whole corpus build: balanced set -> step timings from traces -> JSON target -> seeded shuffle."""
    bal = balanced_set(spark, sf)
    out = examples.enrich_with_traces(bal, traces(spark, sf), id_col="row_key", categories=_TRACE_CATS)
    timing = F.coalesce(F.col("timing_data"), F.create_map().cast("map<string,double>"))
    out = out.withColumn("steps", examples.match_step_timing(F.col("steps"), timing))
    target = F.struct("operation", F.col("output_category").alias("category"), "steps", "complexity", "total_us",
                      "parallelizable_steps", "critical_path_us")
    out = out.withColumn("target", examples.json_target(target)).drop("timing_data")
    return curate.shuffle_seeded(out, "row_key")


@register("build_training_set", None)
def build_training_set(spark, sf):
    """L1 end to end: every example with its prompt hash, target and trace flag."""
    steps = F.transform("steps", lambda s: F.concat_ws("|", s["step"].cast("string"), s["action"],
                                                       s["expected_us"].cast("string")))
    return training_set(spark, sf).select(
        "row_key", "source", "category", "complexity", "n_steps", "total_us", "variation", "source_hash",
        "trace_enhanced", F.array_join(steps, ";").alias("steps"), T.hash16("target").alias("target_hash"),
        F.coalesce(F.col("metadata.lines_of_code"), F.lit(-1)).alias("lines_of_code"),
        F.col("metadata.url").alias("url"))


@register("duplicate_count_after_balance")
def duplicate_count_after_balance(spark, sf):
    """A5 as measured by the reference: repeated source hashes after balancing."""
    return stats.duplicate_count(balanced_set(spark, sf).select(F.col("source_hash").alias("h")), "h")


def _kw_sql(expr, rules, default):
    return S.first_match(expr, rules, default)


@register("classify_resource", _ex_sql() + f"""
SELECT doc_id, step, {_kw_sql('action', R.RESOURCE_RULES, 'CPU')} AS resource_class,
  {_kw_sql('action', R.CRITICALITY_RULES, R.DEFAULT_CRITICALITY)} AS criticality_class FROM st""")
def classify_resource(spark, sf):
    """X9 / X10 over every step action of the code examples."""
    s = examples.one_row_per_step(code_examples(spark, sf), "steps", "s", "doc_id")
    return s.select("doc_id", "s.step", T.classify_resource(F.col("s.action")).alias("resource_class"),
                    T.classify_criticality(F.col("s.action")).alias("criticality_class"))


@register("flatten_steps", _synthetic_sql().replace(
    "SELECT split_part(key, '|', 1) AS source", "SELECT 1 AS _unused, split_part(key, '|', 1) AS source", 1)
    .rsplit("SELECT 1 AS _unused", 1)[0] + """
SELECT split_part(key, '|', 1) AS source, split_part(key, '|', 2) AS operation, CAST(step - 1 AS INTEGER) AS pos,
  step, resource, us AS expected_us FROM st""")
def flatten_steps(spark, sf):
    """M1: nested steps of the synthetic examples to rows (posexplode_outer)."""
    srcs = read_table(spark, sf, "documents").select(F.col("source").alias("src")).distinct()
    ops = F.array(*[F.lit(n) for n, _, _, _ in R.SYNTHETIC_OPERATIONS])
    ex = examples.build_synthetic_examples(srcs.select("src", F.explode(ops).alias("operation")),
                                           id_col="src", op_col="operation")
    f = ex.select(F.col("src").alias("source"), "operation", F.posexplode_outer("steps").alias("pos", "s"))
    return f.select("source", "operation", "pos", "s.step", "s.resource", "s.expected_us")


def _step_list(step, action, resource, criticality, par, deps, us):
    return (f"list({{'step': CAST({step} AS INTEGER), 'action': {action}, 'resource': {resource}, 'criticality': {criticality}, "
            f"'parallelizable': {par}, 'dependencies': {deps}, 'expected_us': CAST({us} AS BIGINT)}} ORDER BY {step})")


def _fixed_list(rows):
    items = ", ".join(
        f"{{'step': CAST({s} AS INTEGER), 'action': {S.lit(a)}, 'resource': {S.lit(res)}, 'criticality': {S.lit(crit)}, "
        f"'parallelizable': false, 'dependencies': {S._arr(deps)}, 'expected_us': CAST({us} AS BIGINT)}}"
        for s, a, us, res, crit, deps in rows)
    return f"[{items}]"


def _title_case_sql(expr, names, suffix=""):
    arms = " ".join(f"WHEN {S.lit(n)} THEN {S.lit(f(n) + suffix)}" for n, f in names)
    return f"(CASE {expr} {arms} END)"


def _training_set_sql():
    level = S.complexity_level("a.n_steps", "e.score")
    ex = _ex_sql()
    code_names = sorted({c for c, _ in FP} | {FD} | {c for _, _, c in R.FIXTURE_CONTEXT_RULES})
    code_op = _title_case_sql("e.category", [(n, lambda x: x.replace("_", " ").title()) for n in code_names],
                              " Implementation")
    gh = (f"SELECT * FROM ({ex} SELECT 'github:' || CAST(e.doc_id AS VARCHAR) AS item_id, 'github' AS source, e.category, "
          f"'Analyze and decompose this ' || e.category || ' code from a production repository' AS instruction, "
          f"'Repository: ' || e.repo || chr(10) || 'File: ' || e.file_path || chr(10) || chr(10) || 'Code:' || chr(10) "
          f"|| e.content AS input, {code_op} AS operation, e.category AS output_category, l.steps, "
          f"a.n_steps, a.total_us, l.par AS parallelizable_steps, c.critical_path_us, {level} AS complexity, "
          f"CAST({S.lines_of_code('e.content')} AS INTEGER) AS loc, NULL AS url "
          f"FROM ex e JOIN agg a USING (doc_id) JOIN cpath c USING (doc_id) JOIN (SELECT doc_id, "
          f"{_step_list('step', 'action', 'resource', 'criticality', 'par', 'deps', 'us')} AS steps, "
          f"coalesce(list(step ORDER BY step) FILTER (par), []) AS par FROM st GROUP BY doc_id) l USING (doc_id))")
    block_names = sorted({c for c, _ in R.CATEGORY_PATTERNS} | {R.DEFAULT_CATEGORY})
    block_cat = S.categorize_scored("block", R.CATEGORY_PATTERNS, R.DEFAULT_CATEGORY)
    block_op = _title_case_sql(block_cat, [(n, str.title) for n in block_names])
    doc = (f"SELECT * FROM ({_blocks_sql(3)} SELECT 'documentation:' || CAST(page_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR), "
           f"'documentation', 'reference_material', 'Explain and decompose this documented network programming pattern', "
           f"'Documentation source: ' || url || chr(10) || chr(10) || 'Code example:' || chr(10) || block, "
           f"'Documentation Study: ' || {block_op}, 'documentation_reference', {_fixed_list(R.DOC_STEPS)}, 3, "
           f"CAST(1200 AS BIGINT), []::INTEGER[], CAST(1200 AS BIGINT), 'low', NULL, url FROM dd)")
    desc = "coalesce(descriptions[pos + 1], 'Tutorial example')"
    tut = (f"SELECT * FROM ({_blocks_sql(2)} SELECT 'tutorial:' || CAST(page_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR), "
           f"'tutorial', 'educational_breakdown', 'Break down this tutorial example into structured learning steps', "
           f"'Tutorial context: ' || {desc} || chr(10) || chr(10) || 'Tutorial source: ' || url || chr(10) || chr(10) "
           f"|| 'Code example:' || chr(10) || block, 'Tutorial Learning: ' || {block_op}, 'educational_content', "
           f"{_fixed_list(R.TUTORIAL_STEPS)}, 4, CAST(1650 AS BIGINT), []::INTEGER[], CAST(1650 AS BIGINT), 'medium', "
           f"NULL, url FROM dd)")
    syn_steps = _synthetic_sql().rsplit("SELECT split_part(key", 1)[0]
    syn = (f"SELECT * FROM ({syn_steps} SELECT 'synthetic:' || split_part(key, '|', 1) || ':' || op, 'synthetic', category, "
           f"'Decompose the network operation: ' || op, 'Analyze the step-by-step process for: ' || op, op, category, "
           f"{_step_list('step', 'action', 'resource', 'criticality', 'par', 'deps', 'us')}, CAST(count(*) AS INTEGER), "
           f"CAST(sum(us) AS BIGINT), coalesce(list(step ORDER BY step) FILTER (par), []), "
           f"(SELECT max(list_max(fin)) FROM cp WHERE cp.key = st.key), complexity, NULL, NULL "
           f"FROM st GROUP BY key, op, category, complexity)")
    instr = "r.instruction"
    for j, target in enumerate(R.VARIATION_TARGETS):
        pick = f"([{_VARS}])[1 + ({_draw('balance', S.lit(f'v{j}'), 'r.category', 'p.copy_no')} % 4)]"
        instr = _replace_first_sql(instr, target, pick)
    arms = " ".join(f"WHEN contains(lower(s.action), '{kw}') AND t.t_{n} IS NOT NULL THEN t.t_{n}"
                    for kw, names in R.SYSCALL_MAPPINGS for n in names)
    columns = ("item_id, source, category, instruction, input, operation, output_category, steps, n_steps, total_us, "
               "parallelizable_steps, critical_path_us, complexity, loc, url")
    return f"""WITH u({columns}) AS (
  {gh} UNION ALL {doc} UNION ALL {tut} UNION ALL {syn}),
h AS (SELECT *, sha256(instruction || chr(31) || input) AS text_key FROM u),
d AS (SELECT * EXCLUDE (rn, text_key) FROM (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY source, item_id) AS rn
  FROM h) WHERE rn = 1),
cnt AS (SELECT category, count(*) AS n FROM d GROUP BY category),
down AS (SELECT * EXCLUDE (rn, n) FROM (SELECT d.*, c.n, row_number() OVER (PARTITION BY d.category
  ORDER BY {_draw('balance', 'd.item_id')}, d.item_id) AS rn FROM d JOIN cnt c USING (category) WHERE c.n > 100)
  WHERE rn <= 100),
orig AS (SELECT d.* FROM d JOIN cnt c USING (category) WHERE c.n <= 100 UNION ALL SELECT * FROM down),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY d.category ORDER BY d.item_id) AS pos, c.n
  FROM d JOIN cnt c USING (category) WHERE c.n < 5),
need AS (SELECT category, n, unnest(range(1, 5 - n + 1)) AS copy_no FROM cnt WHERE n < 5),
picks AS (SELECT category, copy_no, 1 + ({_draw('balance', 'category', 'copy_no')} % n) AS pos FROM need),
up AS (SELECT r.* EXCLUDE (pos, n) REPLACE ({instr} AS instruction), p.copy_no FROM picks p JOIN ranked r USING (category, pos)),
allrows0 AS (SELECT *, false AS variation, 0 AS copy_no FROM orig
  UNION ALL BY NAME SELECT *, true AS variation FROM up),
allrows AS (SELECT *, {S.hash16("instruction || chr(31) || input")} AS source_hash,
  item_id || ':' || CAST(copy_no AS VARCHAR) AS row_key FROM allrows0),
{_TRACES_SQL.rsplit('pick AS (', 1)[0]}
cats AS (SELECT DISTINCT category, m FROM tidx),
pick AS (SELECT r.row_key, t.trace_id FROM allrows r LEFT JOIN cats c USING (category)
  LEFT JOIN tidx t ON t.category = r.category AND t.idx = {S.seeded_draw("trace", "r.row_key")} % c.m),
new_steps AS (SELECT row_key, list(struct_update(s, expected_us := CASE WHEN coalesce(real, 0) <> 0 THEN real
    ELSE s.expected_us END) ORDER BY s.step) AS steps
  FROM (SELECT r.row_key, r.s, CAST(trunc((CASE {arms} END) * 1000000) AS BIGINT) AS real
        FROM (SELECT row_key, unnest(steps) AS s FROM allrows) r JOIN pick p USING (row_key)
        LEFT JOIN traces t ON t.trace_id = p.trace_id) GROUP BY row_key)"""


_TS_SQL = _training_set_sql()


from corpusloom.plans.registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["build_training_set"] = _TS_SQL + f"""
SELECT r.row_key, source, category, complexity, n_steps, total_us, variation, source_hash,
  p.trace_id IS NOT NULL AS trace_enhanced,
  array_to_string(list_transform(n.steps, lambda x: concat_ws('|', x.step, x.action, x.expected_us)), ';') AS steps,
  {S.hash16("to_json({'operation': operation, 'category': output_category, 'steps': n.steps, 'complexity': complexity, "
            "'total_us': total_us, 'parallelizable_steps': parallelizable_steps, 'critical_path_us': critical_path_us})")}
  AS target_hash, coalesce(loc, -1) AS lines_of_code, url
FROM allrows r JOIN pick p USING (row_key) JOIN new_steps n USING (row_key)"""
_ORACLES["duplicate_count_after_balance"] = _TS_SQL + """
SELECT CAST(count(*) - count(DISTINCT source_hash) AS BIGINT) AS duplicate_count FROM allrows"""
