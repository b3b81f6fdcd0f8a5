"""Scale guards on the physical plans of every registered query."""

import json

import pytest

import __spark_entry__ as E
from corpusloom import rules as R
from tests.conftest import SF001

# queries whose construction runs jobs (iterations) have tests of their own
ITERATIVE = {"bpe_merges", "bpe_encode", "bpe_first_merges", "pad_mask", "chars_per_token_bpe", "rate_limit_accept",
             "ttl_cache_hits", *E.LLM_QUERIES}
# a global ordered window is allowed only over a bounded histogram or one row per group
BOUNDED_GLOBAL_WINDOW = {"loc_mean_median", "distribution_pct"}


def _nodes(df):
    return json.loads(df._jdf.queryExecution().sparkPlan().toJSON())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - ITERATIVE))
def test_plan_guards(spark, name):
    nodes = _nodes(E.queries()[name](spark, SF001))
    classes = [n.get("class", "").rsplit(".", 1)[-1] for n in nodes]
    assert "CartesianProductExec" not in classes
    assert "BroadcastNestedLoopJoinExec" not in classes
    if name not in BOUNDED_GLOBAL_WINDOW:
        windows = [n for n in nodes if n.get("class", "").endswith(".WindowExec")]
        assert all(len(n.get("partitionSpec", [])) > 0 for n in windows), "window without partitioning"


def test_guard_sees_global_window(spark):
    nodes = _nodes(E.queries()["loc_mean_median"](spark, SF001))
    windows = [n for n in nodes if n.get("class", "").endswith(".WindowExec")]
    assert windows and len(windows[0].get("partitionSpec", [])) == 0


def _scans(df):
    return [n for n in _nodes(df) if n.get("class", "").endswith("FileSourceScanExec")]


@pytest.mark.parametrize("name,most", [("category_distribution", 1), ("exact_dedupe", 1), ("loc_mean_median", 1),
                                       ("distribution_pct", 3), ("balance_categories", 4),
                                       ("dag_dependencies", 1)])
def test_inputs_are_read_once(spark, name, most):
    """Scans of a query, each of its tables counted; texts never go through a sort aggregate."""
    df = E.queries()[name](spark, SF001)
    assert len(_scans(df)) <= most
    if name in ("category_distribution", "exact_dedupe"):
        assert not [n for n in _nodes(df) if n.get("class", "").endswith("SortAggregateExec")]


def test_training_set_reads_the_written_examples(spark):
    """After the union is written, the corpus build scans it for keys, ids and rows, and the traces for counts and rows."""
    assert len(_scans(E.queries()["build_training_set"](spark, SF001))) <= 10


def test_trace_counts_are_broadcast(spark):
    names = [n.get("class", "").rsplit(".", 1)[-1] for n in _nodes(E.queries()["trace_enrich"](spark, SF001))]
    assert "BroadcastHashJoinExec" in names


@pytest.mark.parametrize("name", ["crosstab_resource", "step_timing", "template_expand", "resource_usage",
                                  "syscall_timing_match"])
def test_texts_are_scored_once_for_all_steps(spark, name):
    """No filter on the number of steps repeats the category and complexity expressions below the joins."""
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("the|of|and") == 1
    assert plan.count("lower(content") + plan.count("lower(text") <= len(R.COMPLEXITY_INDICATORS)


def test_dedupe_collapses_hot_hash_before_shuffle(spark):
    """A text held by a third of the rows is reduced map-side (partial min_by)."""
    from pyspark.sql import functions as F

    from corpusloom.operators.curate import exact_dedupe
    df = spark.range(3000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, F.lit("same text"))
                                  .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = exact_dedupe(df, "text", ["doc_id"])
    assert out.count() == 2001
    assert out.filter(F.col("text") == "same text").first()["doc_id"] == 0
    nodes = json.loads(out._jdf.queryExecution().sparkPlan().toJSON())
    partial = [n for n in nodes if n.get("class", "").endswith("AggregateExec")
               and "Partial" in json.dumps(n.get("aggregateExpressions", ""))]
    assert partial, "expected a partial (map-side) aggregate"
