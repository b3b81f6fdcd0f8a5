"""Training-example construction.

Step templates are a few dozen constant rows, so they are compiled into a
literal ``map<category, array<struct>>`` expression: template expansion,
timing draws, totals and the critical path are then per-row array
expressions evaluated inside the scan stage — no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.functions import text as T

STEP_FIELDS = ("step", "action", "resource", "criticality", "parallelizable", "dependencies")


def _step_struct(step: int, action: str, resource: str, criticality: str, parallelizable: bool,
                 deps: list[int]) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.lit(action).alias("action"), F.lit(resource).alias("resource"),
        F.lit(criticality).alias("criticality"), F.lit(parallelizable).alias("parallelizable"),
        F.array(*[F.lit(d) for d in deps]).cast("array<int>").alias("dependencies"),
    )


def template_steps(templates, compat: bool = False) -> dict[str, list[tuple]]:
    """Normalise template rows to (step, action, resource, criticality, par, deps).

    Dependencies in templates are 0-based indexes; steps are 1-based. By
    default they are shifted to step numbers (D2); ``compat=True`` keeps the
    raw indexes, reproducing the original off-by-one lookup.
    """
    out = {}
    for cat, rows in templates.items():
        out[cat] = [
            (i + 1, a, res, crit, par, [d if compat else d + 1 for d in deps])
            for i, (a, res, crit, _lo, _hi, _typ, par, deps) in enumerate(rows)
        ]
    return out


def generic_steps(compat: bool = False) -> list[tuple]:
    """Five generic steps: I/O if the action mentions network, high if it mentions error."""
    rows = []
    for i, action in enumerate(R.GENERIC_ACTIONS):
        resource = "I/O" if "network" in action.lower() else "CPU"
        crit = "high" if "error" in action.lower() else "medium"
        deps = [i - 1] if i > 0 else []
        rows.append((i + 1, action, resource, crit, False, [d if compat else d + 1 for d in deps]))
    return rows


def templates_map(templates=R.STEP_TEMPLATES, compat: bool = False) -> Column:
    norm = template_steps(templates, compat)
    kv = []
    for cat, rows in norm.items():
        kv += [F.lit(cat), F.array(*[_step_struct(*r) for r in rows])]
    return F.create_map(*kv)


def generic_array(compat: bool = False) -> Column:
    return F.array(*[_step_struct(*r) for r in generic_steps(compat)])


def expand_templates(category: Column, templates=R.STEP_TEMPLATES, compat: bool = False) -> Column:
    """The category's template steps, or the generic steps when it has none."""
    return F.coalesce(F.try_element_at(templates_map(templates, compat), category), generic_array(compat))


def timing_bounds(resource: Column, criticality: Column, base: Column) -> tuple[Column, Column]:
    """X11 bounds: int(range[resource] x (multiplier[criticality] x base))."""
    lo_map = F.create_map(*sum([[F.lit(k), F.lit(v[0])] for k, v in R.BASE_TIMES_US.items()], []))
    hi_map = F.create_map(*sum([[F.lit(k), F.lit(v[1])] for k, v in R.BASE_TIMES_US.items()], []))
    mult = F.create_map(*sum([[F.lit(k), F.lit(v)] for k, v in R.CRITICALITY_MULTIPLIERS.items()], []))
    m = mult[criticality] * base
    return (F.element_at(lo_map, resource) * m).cast("long"), (F.element_at(hi_map, resource) * m).cast("long")


def timed_steps(steps: Column, base: Column, seed: str, key: Column) -> Column:
    """Attach ``expected_us``: a seeded integer draw in [lo, hi] per step."""
    def one(s):
        lo, hi = timing_bounds(s["resource"], s["criticality"], base)
        draw = T.seeded_draw(seed, key, s["step"])
        return s.withField("expected_us", lo + F.pmod(draw, hi - lo + F.lit(1)))
    return F.transform(steps, one)


def one_row_per_step(ex: DataFrame, steps: str, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and one entry of the array column ``steps`` as ``name`` per row; an entry is never null.

    A plain explode of a column makes Spark infer a filter on the array's size and push it, with all
    expressions behind the array written out in place, below the joins: texts are then scored several times a step.
    """
    return ex.select(*keep, F.explode_outer(steps).alias(name)).where(F.col(name).isNotNull())


def total_us(steps: Column) -> Column:
    """A10: total expected microseconds."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + s["expected_us"])


def parallel_steps(steps: Column) -> Column:
    """A10: step numbers of parallelisable steps, in order."""
    return F.transform(F.filter(steps, lambda s: s["parallelizable"]), lambda s: s["step"])


def critical_path(steps: Column) -> Column:
    """finish(s) = time(s) + max finish of its dependencies (unknown = 0); max finish.

    Steps are in topological order (dependencies point backwards), so one
    left fold with a step -> finish map computes it.
    """
    init = F.create_map().cast("map<int,bigint>")

    def fold(acc, s):
        dep_fin = F.array_max(F.transform(s["dependencies"], lambda d: F.coalesce(acc[d], F.lit(0).cast("long"))))
        fin = s["expected_us"] + F.coalesce(dep_fin, F.lit(0).cast("long"))
        return F.map_concat(F.map_filter(acc, lambda k, v: k != s["step"]), F.create_map(s["step"], fin))

    fins = F.aggregate(steps, init, fold)
    return F.coalesce(F.array_max(F.map_values(fins)), F.lit(0).cast("long"))


def code_analysis(df: DataFrame, text_col: str) -> DataFrame:
    """X4-X7 as columns."""
    return (df.withColumn("functions", T.extract_functions(text_col))
              .withColumn("classes", T.extract_classes(text_col))
              .withColumn("imports", T.extract_imports(text_col))
              .withColumn("lines_of_code", T.lines_of_code(text_col))
              .withColumn("complexity_score", T.complexity_score(text_col))
              .withColumn("content_hash", T.hash16(text_col)))


def title_words(col: Column) -> Column:
    """Python str.title() of a snake_case name: each part capitalised, underscores kept."""
    return F.array_join(F.transform(F.split(col, "_"), F.initcap), "_")


def title_case(col: Column) -> Column:
    """Python str.title() for snake_case words after '_' -> ' ' (ASCII words)."""
    return F.initcap(F.regexp_replace(col, "_", " "))


def build_code_examples(files: DataFrame, *, id_col: str = "doc_id", text_col: str = "content",
                        repo_col: str = "repo", path_col: str = "file_path",
                        patterns=R.CATEGORY_PATTERNS, default=R.DEFAULT_CATEGORY,
                        context_rules=R.CONTEXT_RULES, templates=R.STEP_TEMPLATES,
                        seed: str = "timing", compat: bool = False, dedupe: bool = True) -> DataFrame:
    """F1 -> O2 -> X1/X2 -> X4-X6 -> J1 -> X11 -> A10/A11 -> X8.

    One output row per kept file with the decomposition as columns.
    """
    from corpusloom.operators.curate import exact_dedupe

    gated = files.filter(T.length_between(text_col))
    if dedupe:
        gated = exact_dedupe(gated, text_col, [id_col])
    cat = T.categorize_context(text_col, path_col, repo_col, patterns, default, context_rules)
    ex = code_analysis(gated.withColumn("category", cat), text_col)
    steps = timed_steps(expand_templates(F.col("category"), templates, compat),
                        F.col("complexity_score") / F.lit(5.0), seed, F.col(id_col))
    ex = (ex.withColumn("steps", steps)
            .withColumn("n_steps", F.size("steps"))
            .withColumn("total_us", total_us(F.col("steps")))
            .withColumn("parallelizable_steps", parallel_steps(F.col("steps")))
            .withColumn("critical_path_us", critical_path(F.col("steps")))
            .withColumn("complexity", T.complexity_level(F.col("n_steps"), F.col("complexity_score")))
            .withColumn("operation", F.concat(title_case(F.col("category")), F.lit(" Implementation")))
            .withColumn("instruction", F.concat(F.lit("Analyze and decompose this "), F.col("category"),
                                                F.lit(" code from a production repository")))
            .withColumn("input", F.concat(F.lit("Repository: "), F.col(repo_col), F.lit("\nFile: "),
                                          F.col(path_col), F.lit("\n\nCode:\n"), T.truncate_lines(F.col(text_col))))
            .withColumn("source", F.lit("github")))
    return ex


def fixed_steps(rows) -> Column:
    """Literal steps (documentation/tutorial) with their fixed microseconds."""
    return F.array(*[
        F.struct(F.lit(s).alias("step"), F.lit(a).alias("action"), F.lit(res).alias("resource"),
                 F.lit(crit).alias("criticality"), F.lit(False).alias("parallelizable"),
                 F.array(*[F.lit(d) for d in deps]).cast("array<int>").alias("dependencies"),
                 F.lit(us).cast("long").alias("expected_us"))
        for s, a, us, res, crit, deps in rows
    ])


def build_block_examples(items: DataFrame, *, id_col: str, url_col: str, blocks_col: str,
                         kind: str = "documentation", descriptions_col: str | None = None,
                         patterns=R.CATEGORY_PATTERNS, default=R.DEFAULT_CATEGORY) -> DataFrame:
    """First N code blocks per item (cut before filters), stripped length
    >= 50, dedupe on block text, fixed steps; J7 aligns description i to block i."""
    from corpusloom.operators.curate import exact_dedupe

    n = R.DOC_BLOCKS_PER_ITEM if kind == "documentation" else R.TUTORIAL_BLOCKS_PER_ITEM
    cols = [F.col(id_col), F.col(url_col)]
    if descriptions_col:
        cols.append(F.col(descriptions_col))
    exploded = items.select(*cols, F.posexplode(F.slice(F.col(blocks_col), 1, n)).alias("pos", "block"))
    kept = exploded.filter(T.stripped_length("block") >= R.MIN_BLOCK_STRIPPED)
    kept = exact_dedupe(kept, "block", [id_col, "pos"], hash_col="block_hash")
    kept = kept.withColumn("block_category", T.categorize_scored("block", patterns, default))
    if kind == "documentation":
        steps, total, level = R.DOC_STEPS, 1200, "low"
        out = (kept.withColumn("instruction", F.lit("Explain and decompose this documented network programming pattern"))
               .withColumn("input", F.concat(F.lit("Documentation source: "), F.col(url_col),
                                             F.lit("\n\nCode example:\n"), F.col("block")))
               .withColumn("operation", F.concat(F.lit("Documentation Study: "), title_words(F.col("block_category"))))
               .withColumn("category", F.lit("reference_material"))
               .withColumn("output_category", F.lit("documentation_reference")))
    else:
        steps, total, level = R.TUTORIAL_STEPS, 1650, "medium"
        desc = F.coalesce(F.try_element_at(F.col(descriptions_col), F.col("pos") + 1), F.lit("Tutorial example")) \
            if descriptions_col else F.lit("Tutorial example")
        out = (kept.withColumn("description", desc)
               .withColumn("instruction", F.lit("Break down this tutorial example into structured learning steps"))
               .withColumn("input", F.concat(F.lit("Tutorial context: "), F.col("description"),
                                             F.lit("\n\nTutorial source: "), F.col(url_col),
                                             F.lit("\n\nCode example:\n"), F.col("block")))
               .withColumn("operation", F.concat(F.lit("Tutorial Learning: "), title_words(F.col("block_category"))))
               .withColumn("category", F.lit("educational_breakdown"))
               .withColumn("output_category", F.lit("educational_content")))
    return (out.withColumn("steps", fixed_steps(steps))
               .withColumn("n_steps", F.lit(len(steps)))
               .withColumn("total_us", F.lit(total).cast("long"))
               .withColumn("critical_path_us", F.lit(total).cast("long"))
               .withColumn("complexity", F.lit(level))
               .withColumn("source", F.lit(kind)))


def build_synthetic_examples(anchor: DataFrame, *, id_col: str, op_col: str, seed: str = "synthetic",
                             operations=R.SYNTHETIC_OPERATIONS, compat: bool = False) -> DataFrame:
    """One example per (anchor row, operation template) with seeded timings.

    ``anchor`` supplies the rows to build for (e.g. one row per run or per
    source); ``op_col`` names the operation to build.
    """
    ops = {name: rows for name, _, _, rows in operations}
    cats = F.create_map(*sum([[F.lit(n), F.lit(c)] for n, c, _, _ in operations], []))
    levels = F.create_map(*sum([[F.lit(n), F.lit(lv)] for n, _, lv, _ in operations], []))
    steps = timed_steps(F.try_element_at(templates_map(ops, compat), F.col(op_col)), F.lit(1.0), seed,
                        F.concat_ws(":", F.col(id_col).cast("string"), F.col(op_col)))
    return (anchor.withColumn("steps", steps)
            .withColumn("category", cats[F.col(op_col)])
            .withColumn("complexity", levels[F.col(op_col)])
            .withColumn("n_steps", F.size("steps"))
            .withColumn("total_us", total_us(F.col("steps")))
            .withColumn("parallelizable_steps", parallel_steps(F.col("steps")))
            .withColumn("critical_path_us", critical_path(F.col("steps")))
            .withColumn("operation", F.col(op_col))
            .withColumn("instruction", F.concat(F.lit("Decompose the network operation: "), F.col(op_col)))
            .withColumn("input", F.concat(F.lit("Analyze the step-by-step process for: "), F.col(op_col)))
            .withColumn("source", F.lit("synthetic")))


def build_examples_basic(files: DataFrame, *, id_col: str, text_col: str, repo_col: str, path_col: str,
                         rules=R.FIRST_MATCH_RULES, default=R.DEFAULT_CATEGORY, actions=R.BASIC_ACTIONS,
                         seed: str = "basic") -> DataFrame:
    """E5 (older builder): stripped length >= 100, first-match category, a fixed
    action list per category, resource by the older classifier, 50-500 ns draw,
    input cut at 1000 characters plus '...'."""
    gated = files.filter(T.stripped_length(text_col) >= 100)
    cat = T.categorize_first(text_col, rules, default)
    amap = F.create_map(*sum([[F.lit(k), F.array(*[F.lit(a) for a in v])] for k, v in actions.items()], []))
    acts = F.coalesce(F.try_element_at(amap, F.col("category")),
                      F.array(*[F.lit(a) for a in R.BASIC_DEFAULT_ACTIONS]))
    steps = F.transform(acts, lambda a, i: F.struct(
        (i + 1).alias("step"), a.alias("action"),
        F.concat((F.lit(50) + F.pmod(T.seeded_draw(seed, F.col(id_col), i + 1), F.lit(451))).cast("string"),
                 F.lit("ns")).alias("expected_time"),
        T.classify_resource(a, R.RESOURCE_RULES_BASIC, "CPU").alias("resource")))
    return (gated.withColumn("category", cat)
            .withColumn("instruction", F.concat(F.lit("Decompose and analyze this "), F.col("category"), F.lit(" code")))
            .withColumn("input", F.concat(F.lit("Repository: "), F.col(repo_col), F.lit("\nFile: "), F.col(path_col),
                                          F.lit("\nCode:\n"), T.truncate_chars(F.col(text_col), 1000)))
            .withColumn("operation", title_case(F.col("category")))
            .withColumn("steps", steps)
            .withColumn("source", F.lit(R.BASIC_SOURCE)))


def json_target(output: Column) -> Column:
    """M4: compact JSON of a struct (nulls kept)."""
    return F.to_json(output, {"ignoreNullFields": "false"})


# --- trace enrichment (J2, J3) -------------------------------------------------

def index_within_group(df: DataFrame, group: str, order_col: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """0-based index of each row inside its group in ``order_col`` order,
    without ranking a whole group in one task: rows are cut into range
    buckets of ``order_col`` that hold about ``bucket_rows`` rows if ids are
    spread evenly; per-(group, bucket) counts (a small table) give each
    bucket's offset, and rows are numbered inside their bucket."""
    from pyspark.sql import Window
    span = df.select(F.greatest(F.lit(1.0), (F.max(order_col) - F.min(order_col) + 1) * float(bucket_rows)
                                / F.count(F.lit(1)))).scalar()
    b = df.withColumn("_bk", F.floor(F.col(order_col) / span).cast("long"))
    counts = b.groupBy(group, "_bk").agg(F.count(F.lit(1)).alias("_bc"))
    wb = Window.partitionBy(group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_bc").over(wb), F.lit(0))).drop("_bc")
    wi = Window.partitionBy(group, "_bk").orderBy(order_col)
    return (b.join(offs, [group, "_bk"]).withColumn("idx", F.col("_off") + F.row_number().over(wi) - 1)
            .drop("_bk", "_off"))


def enrich_with_traces(ex: DataFrame, traces: DataFrame, *, id_col: str = "doc_id", seed: str = "trace",
                       default_category: str = "general", categories: list[str] | None = None) -> DataFrame:
    """Each example takes one seeded-random trace of its category (traces
    without a category count as ``general``); unmatched examples pass through.

    Traces are numbered inside their category (``index_within_group``) and the
    example picks ``draw mod count`` — an equi-join on (category, index), so
    no example is paired with every trace of its category. With ``categories``,
    the declared list, other traces are left out and the counts, at most one row for each of
    the list, are broadcast: examples aren't shuffled by category to learn a count.
    """
    tr = traces.withColumn("category", F.coalesce("category", F.lit(default_category)))
    if categories is not None:
        tr = tr.where(F.col("category").isin(list(categories)))
    indexed = index_within_group(tr, "category", "trace_id")
    counts = tr.groupBy("category").agg(F.count(F.lit(1)).alias("_m"))
    # without a declared list the size is unknown: no hint, AQE decides by the measured size
    picked = ex.join(F.broadcast(counts) if categories is not None else counts, "category", "left").withColumn(
        "idx", F.when(F.col("_m").isNotNull(), F.pmod(T.seeded_draw(seed, F.col(id_col)), F.col("_m"))))
    out = picked.join(indexed.select("category", "idx", "trace_id", "timing_data"), ["category", "idx"], "left")
    return out.withColumn("trace_enhanced", F.col("trace_id").isNotNull()).drop("_m", "idx")


def match_step_timing(steps: Column, timing: Column, mappings=R.SYSCALL_MAPPINGS) -> Column:
    """For each step, the first keyword (in order) found in the lower-cased
    action whose syscall list has a name present in ``timing`` takes that
    name's seconds x 1e6 (truncated); 0 or no hit leaves the step unchanged."""
    rules = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(n).alias("name"))
                      for k, names in mappings for n in names])

    def one(s):
        hits = F.filter(rules, lambda r: F.contains(F.lower(s["action"]), r["kw"]) &
                        F.coalesce(F.map_contains_key(timing, r["name"]), F.lit(False)))
        us = (F.element_at(timing, F.element_at(hits, 1)["name"]) * F.lit(1000000)).cast("long")
        real = F.when(F.size(hits) > 0, us)
        return s.withField("expected_us", F.when(F.coalesce(real, F.lit(0)) != 0, real).otherwise(s["expected_us"]))

    return F.transform(steps, one)
