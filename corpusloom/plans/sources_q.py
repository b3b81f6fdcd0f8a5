"""Source queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.alloc import claim_batches
from corpusloom.plans.bindings import tasks
from corpusloom.plans.registry import register
from corpusloom.session import read_table
from corpusloom.sources.readers import edge_header, parse_edge_lines


def _edge_lines(spark, sf):
    """An edge-list text derived from `orders` (customer -> order), with a
    '#' header, CRLF endings on odd keys, tab separators."""
    o = read_table(spark, sf, "orders")
    body = o.select(F.concat(F.col("o_custkey").cast("string"), F.lit("\t"), F.col("o_orderkey").cast("string"),
                             F.when(F.col("o_orderkey") % 2 == 1, F.lit("\r")).otherwise(F.lit(""))).alias("value"))
    head = o.agg(F.concat(F.lit("# Nodes: "), F.countDistinct("o_custkey").cast("string"), F.lit(" Edges: "),
                          F.count(F.lit(1)).cast("string")).alias("value"))
    return head.unionByName(body)


@register("edge_list_parse", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def edge_list_parse(spark, sf):
    return parse_edge_lines(_edge_lines(spark, sf))


@register("edge_list_header", "SELECT count(DISTINCT o_custkey) AS nodes, count(*) AS edges FROM orders")
def edge_list_header(spark, sf):
    return edge_header(_edge_lines(spark, sf))


@register("task_batch_fifo", """SELECT o_orderkey AS task_id, o_orderdate AS created_at FROM orders
ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def task_batch_fifo(spark, sf):
    """A FIFO batch of 20 tasks by (created_at, id)."""
    return tasks(spark, sf).select("task_id", "created_at").orderBy("created_at", "task_id").limit(20)


@register("task_batch_claims", """SELECT o_orderkey AS task_id, o_orderdate AS created_at,
  CASE (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 20 WHEN 0 THEN 'decomposer_1' WHEN 1 THEN 'decomposer_2'
  ELSE 'decomposer_3' END AS assigned_to FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 60""")
def task_batch_claims(spark, sf):
    """Three decomposers claim a batch of 20 tasks each, first come first served."""
    t = tasks(spark, sf).select("task_id", "created_at")
    return claim_batches(t, ["decomposer_1", "decomposer_2", "decomposer_3"], 20, ["created_at", "task_id"])
