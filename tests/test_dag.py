"""Longest paths over DAG edge tables against a plain recursion; cycles raise a typed error."""

import random

import pytest

from corpusloom.operators import dag

NODES, EDGES = "task_id string, subtask_id string, weight double", "task_id string, src string, dst string"


def _finish(weights, sources):
    memo = {}

    def at(v):
        if v not in memo:
            before = max([at(u) for u in sources.get(v, ())] + [(0.0, 0)])
            memo[v] = (weights[v] + before[0], before[1] + 1)
        return memo[v]

    return {v: at(v) for v in weights}


def test_against_recursion(spark):
    rng = random.Random(3)
    nodes, edges, want = [], [], {}
    for t, n in (("a", 9), ("b", 1), ("c", 5), ("hot", 14)):
        names = [f"n{i:03d}" for i in range(n)]
        rng.shuffle(names)
        weights = {v: float(rng.randint(0, 20)) for v in names}
        own = [(names[i], names[j]) for i in range(n) for j in range(i + 1, min(n, i + 4)) if rng.random() < 0.6]
        sources = {}
        for u, v in own:
            sources.setdefault(v, set()).add(u)
        want |= {(t, v): f for v, f in _finish(weights, sources).items()}
        nodes += [(t, v, w) for v, w in weights.items()]
        edges += [(t, u, v) for u, v in own]
    edges += edges[:20] + [("a", "absent", nodes[0][1]), ("a", nodes[0][1], "absent"), ("none", "x", "y")]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    got = {(r["task_id"], r["subtask_id"]): (r["finish"], r["hops"]) for r in dag.finish_times(n, e).collect()}
    assert got == want
    some = "task_id in ('b', 'c')"
    best = {r["task_id"]: (r["critical_path_weight"], r["critical_path_nodes"]) for r in
            dag.critical_paths(n.where(some), e.where(some)).collect()}
    assert best == {t: max(f for (u, _), f in want.items() if u == t) for t in ("b", "c")}


def test_cycles_raise(spark):
    n = spark.createDataFrame([("t", v, 1.0) for v in "abcd"] + [("u", "a", 1.0)], NODES)
    with pytest.raises(dag.CycleError) as error:
        dag.finish_times(n, spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "b"), ("t", "c", "d")], EDGES))
    assert error.value.examples == [("t", "b"), ("t", "c"), ("t", "d")]
    with pytest.raises(dag.CycleError):
        dag.finish_times(n, spark.createDataFrame([("u", "a", "a")], EDGES))


def test_empty_and_null_weights(spark):
    n = spark.createDataFrame([("t", "a", None), ("t", "b", 2.0)], NODES)
    none = spark.createDataFrame([], EDGES)
    assert {tuple(r) for r in dag.finish_times(n, none).collect()} == {("t", "a", 0.0, 1), ("t", "b", 2.0, 1)}
    assert dag.critical_paths(n.where("false"), none).collect() == []


def test_tasks_solved_in_place_or_in_waves(spark, monkeypatch):
    """Small tasks take one shuffle by task and no waves; larger ones give the same by waves; circles raise from both."""
    rng = random.Random(5)
    nodes = [(t, f"n{i}", float(rng.randint(-3, 9)) if i % 4 else None) for t, n in (("a", 12), ("b", 4), ("c", 1)) for i in range(n)]
    nodes += [("a", "n3", 50.0), (None, "n0", 1.0)]
    edges = [(t, f"n{i}", f"n{j}") for t, n in (("a", 12), ("b", 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
    edges += edges[:5] + [("a", "absent", "n1"), ("none", "n0", "n1"), ("b", None, "n1")]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    waves = {tuple(r) for r in dag.critical_paths(n, e, max_rows=0).collect()}
    mixed = {tuple(r) for r in dag.critical_paths(n, e, max_rows=10).collect()}
    calls = []
    monkeypatch.setattr(dag, "finish_times", lambda *a: calls.append(a))
    assert {tuple(r) for r in dag.critical_paths(n, e).collect()} == waves == mixed
    assert not calls and {t for t, *_ in waves} == {"a", "b", "c"}
    monkeypatch.undo()
    with pytest.raises(dag.CycleError):
        dag.critical_paths(n, spark.createDataFrame([("b", "n0", "n1"), ("b", "n1", "n0")], EDGES))
