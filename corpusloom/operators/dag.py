"""Longest paths over stored task DAGs (A11 over edge tables).

Nodes are taken off in waves: a wave holds the nodes none of whose sources is left. Its finish times (own weight
plus the latest finish among the sources) are handed along its edges, which are then dropped, so every edge
is joined once with its source's finish. What is left after each wave is written to the shared folder; the number of
waves is the number of nodes on the longest chain of any task. Tasks are solved together, keyed by (task, node), so a
task with most of the nodes spreads like many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.session import materialized

#: rows (nodes and edges) of a task that a worker holds to solve it by itself
MAX_ROWS = 1 << 16


class CycleError(ValueError):
    """The edges of some task run in a circle; ``examples`` are (task_id, subtask_id) on or behind one."""

    def __init__(self, examples: list[tuple[str, str]]):
        super().__init__(f"no order exists for subtasks such as {examples}")
        self.examples = examples


def finish_times(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, subtask_id, finish, hops): the heaviest chain that ends in each node, and its number of nodes.

    ``nodes`` (task_id, subtask_id, weight), unique per task; ``edges`` (task_id, src, dst). Among equally heavy chains
    the longer one counts. Edges from a source that isn't a node count for nothing, as do edges to
    none and repeated ones; null weights are zero. Raises `CycleError`.
    """
    keys = ["task_id", "subtask_id"]
    left = materialized(nodes.select(*keys, F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"),
                                     F.struct(F.lit(0.0).alias("finish"), F.lit(0).cast("long").alias("hops")).alias("best")), "dag-nodes")
    edges = edges.select("task_id", "src", "dst").distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("task_id", F.col("subtask_id").alias(end)), ["task_id", end], "left_semi")
    edges = materialized(edges.select("task_id", "src", "dst"), "dag-edges")
    waves: list[DataFrame] = []
    n_left = left.count()
    while n_left:
        blocked = edges.select("task_id", F.col("dst").alias("subtask_id")).distinct()
        wave = materialized(left.join(blocked, keys, "left_anti").select(
            *keys, F.struct((F.col("weight") + F.col("best.finish")).alias("finish"),
                            (F.col("best.hops") + 1).alias("hops")).alias("done")), "dag-wave")
        found = wave.count()
        if not found:
            raise CycleError([tuple(r) for r in left.select(*keys).orderBy(*keys).limit(5).collect()])
        waves.append(wave.select(*keys, "done.finish", "done.hops"))
        n_left -= found
        if not n_left:
            break
        source = wave.select("task_id", F.col("subtask_id").alias("src"), "done")
        handed = (edges.join(source, ["task_id", "src"]).groupBy("task_id", F.col("dst").alias("subtask_id"))
                  .agg(F.max("done").alias("came")))
        left = materialized(left.join(wave.select(*keys), keys, "left_anti").join(handed, keys, "left").select(
            *keys, "weight", F.greatest("best", F.coalesce("came", "best")).alias("best")), "dag-nodes")
        edges = materialized(edges.join(source.drop("done"), ["task_id", "src"], "left_anti"), "dag-edges")
    if not waves:
        return left.select(*keys, "best.finish", "best.hops")
    out = waves[0]
    for wave in waves[1:]:
        out = out.union(wave)
    return out


def _heaviest(weights: dict[str, float], edges: set[tuple[str, str]]) -> tuple[float, int] | None:
    """(weight, number of nodes) of the heaviest chain of one task; None if edges run in a circle."""
    after: dict[str, list[str]] = {}
    sources = dict.fromkeys(weights, 0)
    for src, dst in edges:
        if src in sources and dst in sources:
            after.setdefault(src, []).append(dst)
            sources[dst] += 1
    ready = [node for node, n in sources.items() if not n]
    came: dict[str, tuple[float, int]] = {}
    best, taken = None, 0
    while ready:
        node = ready.pop()
        taken += 1
        finish, hops = came.get(node, (0.0, 0))
        done = (weights[node] + finish, hops + 1)
        if best is None or done > best:
            best = done
        for dst in after.get(node, ()):
            if done > came.get(dst, (0.0, 0)):
                came[dst] = done
            sources[dst] -= 1
            if not sources[dst]:
                ready.append(dst)
    return best if taken == len(weights) else None


def _tasks_in_turn(max_rows: int):
    """Nodes and edges in order of their tasks -> one row per task; one task's rows are held at a time, ``max_rows`` at most."""
    names = ["task_id", "finish", "hops", "n_subtasks", "total_weight", "solved"]
    types = [None, pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_rows, weights, edges, count, total = None, 0, {}, set(), 0, None
        out: list[tuple] = []

        def close():
            if task is not None and count:
                best = _heaviest(weights, edges) if n_rows <= max_rows else None
                out.append((task, *(best or (None, None)), count, total, best is not None))

        def batch_of(kind):
            columns = list(zip(*out)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(columns, types)], names=names)
            out.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at, node, dst, weight in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != task:
                    close()
                    task, n_rows, weights, edges, count, total = at, 0, {}, set(), 0, None
                n_rows += 1
                if dst is not None:
                    if n_rows <= max_rows:
                        edges.add((node, dst))
                    continue
                count += 1
                if weight is not None:
                    total = weight if total is None else total + weight
                if n_rows <= max_rows:
                    weights[node] = max(weights.get(node, float("-inf")), weight or 0.0)
            yield batch_of(kind)
        close()
        if out:
            yield batch_of(kind)

    return run


def critical_paths(nodes: DataFrame, edges: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per task: weight of the heaviest chain, its number of nodes, the number of nodes and their total weight.

    Nodes and edges are dealt out by task once, and each task is solved where its rows are. Tasks with more than
    ``max_rows`` rows aren't held by a worker: they are solved in waves (`finish_times`), as are those with a circle, which raises.
    """
    key = nodes.schema["task_id"].dataType
    weight, none = F.col("weight").cast("double").alias("weight"), F.lit(None)
    rows = (nodes.select("task_id", F.col("subtask_id").alias("node"), none.cast("string").alias("dst"), weight)
            .unionByName(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
                "task_id", F.col("src").alias("node"), "dst", none.cast("double").alias("weight")))
            .where(F.col("task_id").isNotNull()))
    schema = T.StructType([T.StructField("task_id", key), T.StructField("finish", T.DoubleType()),
                           T.StructField("hops", T.LongType()), T.StructField("n_subtasks", T.LongType()),
                           T.StructField("total_weight", T.DoubleType()), T.StructField("solved", T.BooleanType())])
    solved = materialized(rows.repartition("task_id").sortWithinPartitions("task_id").mapInArrow(
        _tasks_in_turn(max_rows), schema), "dag-tasks")
    out = solved.where("solved").select("task_id", F.col("finish").alias("critical_path_weight"),
                                        F.col("hops").alias("critical_path_nodes"), "n_subtasks", "total_weight")
    rest = solved.where("not solved").select("task_id", "n_subtasks", "total_weight")
    if rest.isEmpty():
        return out
    left = [x.join(rest.select("task_id"), "task_id", "left_semi") for x in (nodes, edges)]
    best = finish_times(*left).groupBy("task_id").agg(F.max(F.struct("finish", "hops")).alias("best"))
    return out.unionByName(rest.join(best, "task_id").select(
        "task_id", F.col("best.finish").alias("critical_path_weight"), F.col("best.hops").alias("critical_path_nodes"),
        "n_subtasks", "total_weight"))
