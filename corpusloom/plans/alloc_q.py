"""Queue allocation and queue-log queries over `lineitem`, `orders` and
`events` (W6-W12, W15-W17, A13-A16, R1, R2, R7) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.operators import alloc
from corpusloom.operators.curate import first_k_per_group
from corpusloom.plans.bindings import QUEUE_LOG_SQL, queue_log
from corpusloom.plans.registry import register
from corpusloom.session import read_table

# our fixture queue settings (same shape as the reference's): small depths so
# that the value-derived depth samples cross both hysteresis thresholds
FIXTURE_QUEUES = [
    ("gpu_queue", 1000, 100, 0.8, 20, 5, 100, "priority_aware"),
    ("cpu_queue", 1500, 200, 0.85, 50, 3, 50, "load_balanced"),
    ("io_queue", 800, 50, 0.7, 10, 3, 200, "batch_optimized"),
]
RATE_GAP_SECONDS = 300
TTL_SECONDS = R.CACHE_TTL_SECONDS
RING_CAPACITY = 50
HISTORY_N = 5

_ORDER = ["parent", "l_linenumber", "l_partkey", "l_suppkey", "weight", "l_extendedprice", "l_discount", "l_tax",
          "l_shipdate"]


def allocations(spark, sf):
    li = read_table(spark, sf, "lineitem")
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("_p"))
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    cat = (F.when(F.col("l_returnflag") == "A", "gpu_tasks").when(F.col("l_returnflag") == "N", "cpu_tasks")
           .otherwise("io_tasks"))
    return j.select(
        F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("weight"), "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        cat.alias("category"),
        F.when(F.col("_p").isin("1", "2"), 3).when(F.col("_p") == "3", 2).otherwise(1).alias("flow_control_priority"),
        F.when(cat == "gpu_tasks", "gpu_queue").when(cat == "cpu_tasks", "cpu_queue").otherwise("io_queue")
        .alias("target_queue"),
        (cat != "io_tasks").alias("batching_eligible"))


_ALLOC_SQL = """WITH a AS (SELECT l_orderkey AS parent, l_linenumber, l_partkey, l_suppkey, l_quantity AS weight,
  l_extendedprice, l_discount, l_tax, l_shipdate,
  CASE WHEN l_returnflag = 'A' THEN 'gpu_tasks' WHEN l_returnflag = 'N' THEN 'cpu_tasks' ELSE 'io_tasks' END AS category,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 3 WHEN substr(o_orderpriority, 1, 1) = '3' THEN 2 ELSE 1 END
    AS flow_control_priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
q AS (SELECT *, CASE category WHEN 'gpu_tasks' THEN 'gpu_queue' WHEN 'cpu_tasks' THEN 'cpu_queue' ELSE 'io_queue' END
  AS target_queue, category <> 'io_tasks' AS batching_eligible FROM a),
cfg AS (SELECT * FROM (VALUES """ + ", ".join(f"('{q}', {d}, {b})" for q, d, b, *_ in R.QUEUE_CONFIG) + """)
  v(queue, max_depth, max_batch_size)),
depth AS (SELECT target_queue AS queue, count(*) AS depth FROM q GROUP BY ALL),
lim AS (SELECT c.queue, CASE WHEN coalesce(d.depth, 0) > c.max_depth * 0.7 THEN greatest(1, c.max_batch_size // 2)
  ELSE c.max_batch_size END AS batch_limit FROM cfg c LEFT JOIN depth d USING (queue)),
ranked AS (SELECT q.*, l.batch_limit, row_number() OVER (PARTITION BY target_queue ORDER BY flow_control_priority DESC,
  weight DESC, parent, l_linenumber, l_partkey, l_suppkey, weight, l_extendedprice, l_discount, l_tax, l_shipdate)
  AS alloc_rank FROM q JOIN lim l ON q.target_queue = l.queue),
alloc AS (SELECT * FROM ranked WHERE alloc_rank <= batch_limit)"""


def allocated(spark, sf):
    a = allocations(spark, sf)
    # queue depth needs no priority: count straight from the lineitem scan (no join)
    li = read_table(spark, sf, "lineitem")
    q = (F.when(F.col("l_returnflag") == "A", "gpu_queue").when(F.col("l_returnflag") == "N", "cpu_queue")
         .otherwise("io_queue"))
    depth = li.groupBy(q.alias("queue")).agg(F.count(F.lit(1)).alias("depth"))
    return alloc.allocate(a, alloc.queue_config(spark), depth, _ORDER)


@register("allocate_subtasks", _ALLOC_SQL + """
SELECT target_queue, CAST(alloc_rank AS INTEGER) AS alloc_rank, parent, l_linenumber, weight, flow_control_priority
FROM alloc""")
def allocate_subtasks(spark, sf):
    """W7 with J5 queue mapping."""
    return allocated(spark, sf).select("target_queue", "alloc_rank", "parent", "l_linenumber", "weight",
                                       "flow_control_priority")


@register("similarity_batches", _ALLOC_SQL + """,
k AS (SELECT *, sum(CASE WHEN NOT batching_eligible THEN 1 ELSE 0 END) OVER (PARTITION BY target_queue) AS n,
  row_number() OVER (PARTITION BY target_queue, batching_eligible ORDER BY category, weight, parent, l_linenumber,
  l_partkey, l_suppkey, weight, l_extendedprice, l_discount, l_tax, l_shipdate) AS r FROM alloc)
SELECT target_queue, CAST(alloc_rank AS INTEGER) AS alloc_rank, CAST(CASE WHEN NOT batching_eligible THEN r
  ELSE greatest(n, 1) + (r - 1 + CASE WHEN n > 0 THEN 1 ELSE 0 END) // 10 END AS INTEGER) AS batch_no FROM k""")
def similarity_batches(spark, sf):
    b = alloc.similarity_batches(allocated(spark, sf), _ORDER)
    return b.select("target_queue", "alloc_rank", "batch_no")


@register("fixed_batches", _ALLOC_SQL + """,
f AS (SELECT *, CAST((alloc_rank - 1) // 50 AS INTEGER) AS fixed_batch FROM alloc),
g AS (SELECT *, min(CASE WHEN l_discount >= 0.09 THEN alloc_rank END) OVER (PARTITION BY target_queue, fixed_batch)
  AS first_rej FROM f)
SELECT target_queue, CAST(alloc_rank AS INTEGER) AS alloc_rank, fixed_batch,
  (first_rej IS NULL OR alloc_rank < first_rej) AS accepted FROM g""")
def fixed_batches(spark, sf):
    b = alloc.fixed_batches(allocated(spark, sf), F.col("l_discount") >= 0.09)
    return b.select("target_queue", "alloc_rank", "fixed_batch", "accepted")


# --- queue log (events) -------------------------------------------------------

def _prio():
    return (F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2)
            .when(F.col("event_type") == "view", 1))


@register("priority_take", f"""WITH l AS ({QUEUE_LOG_SQL})
SELECT queue, event_id FROM (SELECT queue, event_id, row_number() OVER (PARTITION BY queue ORDER BY
  -coalesce(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 END, 0), ts, event_id) AS rn
  FROM l) WHERE rn <= 100""")
def priority_take(spark, sf):
    """HIGH, MEDIUM, LOW (FIFO each), then unprioritised; 100 per queue."""
    lg = queue_log(spark, sf).withColumn("priority", _prio())
    return alloc.priority_take(lg, "queue", "priority", ["ts", "event_id"], 100).select("queue", "event_id")


@register("queue_depth_peak", f"""WITH l AS ({QUEUE_LOG_SQL}),
r AS (SELECT *, sum(delta) OVER (PARTITION BY queue ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM l)
SELECT queue, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS writes,
  CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reads,
  CAST(max(depth) AS BIGINT) AS peak_depth, CAST(arg_max(depth, (ts, event_id)) AS BIGINT) AS current_depth
FROM r GROUP BY queue""")
def queue_depth_peak(spark, sf):
    """Writes, reads, running depth (two-level scan), peak and current."""
    r = alloc.running_sum(queue_log(spark, sf), "queue", "ts", "event_id", "delta", "depth")
    return r.groupBy("queue").agg(
        F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).cast("long").alias("writes"),
        F.sum(F.when(F.col("delta") < 0, 1).otherwise(0)).cast("long").alias("reads"),
        F.max("depth").cast("long").alias("peak_depth"),
        F.max_by("depth", F.struct("ts", "event_id")).cast("long").alias("current_depth"))


_FQ = ", ".join(f"('{q}', {d}, {t})" for q, d, _b, t, *_ in FIXTURE_QUEUES)


@register("flow_control_state", f"""WITH l AS ({QUEUE_LOG_SQL}),
c AS (SELECT * FROM (VALUES {_FQ}) v(queue, max_depth, thr)),
s AS (SELECT l.queue, l.event_id, l.ts, CASE WHEN CAST(trunc(l.value * 40) AS INTEGER) > c.max_depth * c.thr THEN true
  WHEN CAST(trunc(l.value * 40) AS INTEGER) < c.max_depth * 0.5 THEN false END AS sig FROM l JOIN c USING (queue))
SELECT queue, event_id, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY queue ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING), false) AS flow_control FROM s""")
def flow_control_state(spark, sf):
    """W10 over depth samples (value x 40) with our fixture queue settings."""
    cfg = alloc.queue_config(spark, FIXTURE_QUEUES)
    s = queue_log(spark, sf).withColumn("depth", (F.col("value") * 40).cast("int"))
    return alloc.flow_control_state(s, cfg).select("queue", "event_id", "flow_control")


def _admission(spark, sf):
    log = queue_log(spark, sf).select("queue", "event_id", "ts", "delta")
    return alloc.clamp_admission(log, "queue", "ts", "event_id", "delta", RING_CAPACITY)


_ADM_SQL = f"""WITH RECURSIVE l AS ({QUEUE_LOG_SQL}),
o AS (SELECT queue, event_id, delta, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id) AS rn FROM l),
w AS (SELECT queue, rn, event_id, delta, CAST(0 AS BIGINT) AS before,
    CASE WHEN delta > 0 THEN least(1, 63) WHEN delta < 0 THEN 0 ELSE 0 END AS after FROM o WHERE rn = 1
  UNION ALL SELECT o.queue, o.rn, o.event_id, o.delta, w.after,
    CASE WHEN o.delta > 0 THEN least(w.after + 1, 63) WHEN o.delta < 0 THEN greatest(w.after - 1, 0) ELSE w.after END
  FROM w JOIN o ON o.queue = w.queue AND o.rn = w.rn + 1)"""


@register("bounded_admission", _ADM_SQL + """
SELECT queue, event_id, CAST(after AS BIGINT) AS depth_after, (delta > 0 AND before >= 63) AS rejected FROM w""")
def bounded_admission(spark, sf):
    """Ring of capacity 50 -> 64 slots, 63 usable; reject enqueues when full."""
    return _admission(spark, sf).select("queue", "event_id", "depth_after", "rejected")


@register("queue_health", _ADM_SQL + """,
h AS (SELECT w.queue, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS enqueued,
  CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS dequeued,
  CAST(sum(CASE WHEN delta > 0 AND before >= 63 THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
  CAST(arg_max(after, rn) AS BIGINT) AS depth FROM w GROUP BY w.queue)
SELECT queue, enqueued, dequeued, rejected, depth, 63 AS capacity, round(depth / 63.0, 6) AS utilization FROM h""")
def queue_health(spark, sf):
    """Throughput counters and final depth / utilisation per queue."""
    h = alloc.health(_admission(spark, sf))
    return h.select("queue", "enqueued", "dequeued", "rejected", "depth", F.lit(63).alias("capacity"),
                    F.round(F.col("depth") / 63.0, 6).alias("utilization"))


@register("system_health", _ADM_SQL + """,
h AS (SELECT w.queue, sum(CASE WHEN delta <> 0 THEN 1 ELSE 0 END) AS ops, arg_max(after, rn) AS depth
  FROM w GROUP BY w.queue)
SELECT round(avg(depth / 63.0), 6) AS average_utilization, CAST(sum(ops) AS BIGINT) AS total_throughput,
  CAST(count(*) AS BIGINT) AS total_queues FROM h""")
def system_health(spark, sf):
    """Second-level aggregate over the per-queue health rows."""
    h = alloc.health(_admission(spark, sf))
    return h.agg(F.round(F.avg(F.col("depth") / 63.0), 6).alias("average_utilization"),
                 F.sum(F.col("enqueued") + F.col("dequeued")).cast("long").alias("total_throughput"),
                 F.count(F.lit(1)).alias("total_queues"))


@register("queue_alerts", _ADM_SQL + f""",
h AS (SELECT w.queue, sum(CASE WHEN delta <> 0 THEN 1 ELSE 0 END) AS ops, arg_max(after, rn) / 63.0 AS u
  FROM w GROUP BY w.queue)
SELECT queue, 'CRITICAL' AS level FROM h WHERE u >= {R.ALERT_UTILIZATION_CRITICAL}
UNION ALL SELECT queue, 'WARNING' FROM h WHERE u < {R.ALERT_UTILIZATION_CRITICAL} AND u >= {R.ALERT_UTILIZATION_WARNING}
UNION ALL SELECT queue, 'INFO' FROM h WHERE ops < {R.ALERT_THROUGHPUT_MIN}""")
def queue_alerts(spark, sf):
    """Utilisation >= .95 critical, >= .80 warning; fewer operations than the rules' minimum info."""
    h = alloc.health(_admission(spark, sf)).select(
        "queue", (F.col("depth") / 63.0).alias("u"), (F.col("enqueued") + F.col("dequeued")).alias("ops"))
    util = (F.when(F.col("u") >= R.ALERT_UTILIZATION_CRITICAL, "CRITICAL")
            .when(F.col("u") >= R.ALERT_UTILIZATION_WARNING, "WARNING"))
    a = h.select("queue", util.alias("level")).filter(F.col("level").isNotNull())
    b = h.filter(F.col("ops") < R.ALERT_THROUGHPUT_MIN).select("queue", F.lit("INFO").alias("level"))
    return a.unionByName(b)


def _greedy_sql(key, gap, cmp):
    return f"""WITH RECURSIVE l AS ({QUEUE_LOG_SQL}),
o AS (SELECT {key} AS k, event_id, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM l),
w AS (SELECT k, rn, event_id, true AS ok, ts AS last FROM o WHERE rn = 1
  UNION ALL SELECT o.k, o.rn, o.event_id, (epoch_us(o.ts) - epoch_us(w.last)) {cmp} CAST({gap} AS BIGINT) * 1000000,
    CASE WHEN (epoch_us(o.ts) - epoch_us(w.last)) {cmp} CAST({gap} AS BIGINT) * 1000000 THEN o.ts ELSE w.last END
  FROM w JOIN o ON o.k = w.k AND o.rn = w.rn + 1)"""


@register("rate_limit_accept", _greedy_sql("queue", RATE_GAP_SECONDS, ">=") + """
SELECT k AS queue, event_id, ok AS accepted FROM w""")
def rate_limit_accept(spark, sf):
    """Reject when the time since the last accepted item is < 1/rate."""
    g = alloc.greedy_gap(queue_log(spark, sf).select("queue", "event_id", "ts"), "queue", "ts", "event_id",
                         RATE_GAP_SECONDS, inclusive=True)
    return g.select("queue", "event_id", "accepted")


@register("ttl_cache_hits", _greedy_sql("user_id", TTL_SECONDS, ">") + """
SELECT k AS user_id, event_id, NOT ok AS cache_hit FROM w""")
def ttl_cache_hits(spark, sf):
    """A key repeated within 3600 s of its insertion is a hit; a hit does
    not refresh; a later repeat re-inserts."""
    g = alloc.greedy_gap(queue_log(spark, sf).select("user_id", "event_id", "ts"), "user_id", "ts", "event_id",
                         TTL_SECONDS, inclusive=False, out="inserted")
    return g.select("user_id", "event_id", (~F.col("inserted")).alias("cache_hit"))


@register("recent_history", f"""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= {HISTORY_N}""")
def recent_history(spark, sf):
    """Keep the most recent N entries per producer."""
    e = read_table(spark, sf, "events").select("user_id", "event_id", "ts")
    e = e.withColumn("_age", -alloc.epoch_micros(F.col("ts"))).withColumn("_nid", -F.col("event_id"))
    return first_k_per_group(e, "user_id", ["_age", "_nid"], HISTORY_N).select("user_id", "event_id")


@register("last_heartbeat", """WITH h AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id)
SELECT user_id, last_seen, last_seen < (SELECT max(last_seen) FROM h) - INTERVAL 7 DAY AS stale FROM h""")
def last_heartbeat(spark, sf):
    """Last seen per worker; stale when 7 days behind the newest heartbeat."""
    h = read_table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    newest = h.select(F.max("last_seen")).scalar()  # scalar subquery, partial aggregation
    return h.select("user_id", "last_seen", (F.col("last_seen") < newest - F.expr("INTERVAL 7 DAYS")).alias("stale"))


@register("metrics_tumbling", f"""WITH l AS ({QUEUE_LOG_SQL})
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, queue, count(*) AS n, round(sum(value), 6) AS total_value
FROM l GROUP BY ALL""")
def metrics_tumbling(spark, sf):
    """R2 (batch twin): counts per tumbling window and queue (1 hour here, 30 s in the reference)."""
    lg = queue_log(spark, sf)
    w = F.window(F.col("ts"), "1 hour")
    return lg.groupBy(w.alias("w"), "queue").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6)
                                                 .alias("total_value")).select(
        F.col("w.start").alias("window_start"), "queue", "n", "total_value")


@register("funnel_counts", """SELECT user_id AS producer, count(*) AS n_items, CAST(ceil(count(*) / 8) AS BIGINT) AS n_passes
FROM events GROUP BY user_id""")
def funnel_counts(spark, sf):
    """R1 (batch twin): items per producer and passes of up to 8 items."""
    e = read_table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("producer")).agg(F.count(F.lit(1)).alias("n_items")).withColumn(
        "n_passes", F.ceil(F.col("n_items") / 8).cast("long"))


@register("worker_metrics", """WITH t AS (SELECT o_orderkey, o_custkey % 3 AS worker,
  (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_sub FROM orders o)
SELECT CAST(worker AS BIGINT) AS worker, count(*) AS tasks_processed, CAST(sum(n_sub) AS BIGINT) AS subtasks_generated,
  CAST(sum(CASE WHEN n_sub = 0 THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  CAST(1000 AS BIGINT) AS history_limit, round(least(sum(n_sub), 1000) / greatest(1, sum(n_sub)), 6) AS allocation_efficiency
FROM t GROUP BY worker""")
def worker_metrics(spark, sf, history_limit: int = R.HISTORY_LIMIT):
    """Per decomposer (customer key mod 3 as worker id): tasks, subtasks,
    tasks without subtasks as errors, efficiency = min(subtasks, history_limit) / max(1, subtasks).
    The measure is over a bounded history by definition, so it falls with volume; its bound is
    reported beside it."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_sub"))
    t = o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        F.pmod("o_custkey", F.lit(3)).cast("long").alias("worker"), F.coalesce("n_sub", F.lit(0)).alias("n_sub"))
    g = t.groupBy("worker").agg(F.count(F.lit(1)).alias("tasks_processed"),
                                F.sum("n_sub").cast("long").alias("subtasks_generated"),
                                F.sum(F.when(F.col("n_sub") == 0, 1).otherwise(0)).cast("long").alias("error_count"))
    return g.withColumn("history_limit", F.lit(history_limit).cast("long")).withColumn("allocation_efficiency", F.round(
        F.least(F.col("subtasks_generated"), F.lit(history_limit)) /
        F.greatest(F.lit(1), F.col("subtasks_generated")), 6))
