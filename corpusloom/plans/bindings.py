"""Bindings of the reference objects to the driver tables.

Each binding has a Spark form and the equivalent DuckDB CTE body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.session import read_table


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as code files: content = text, repo = source, path = source/lang/doc_id."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("content"), F.col("source").alias("repo"),
                    F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file_path"), "lang")


CODE_FILES_SQL = ("SELECT doc_id, text AS content, source AS repo, "
                  "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS file_path, lang FROM documents")


def code_documents(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` with code lines (by doc_id) in front of each text."""
    code = F.array(*[F.lit(c) for c in R.FIXTURE_CODE])
    pick = F.element_at(code, (F.pmod("doc_id", F.lit(len(R.FIXTURE_CODE))) + 1).cast("int"))
    return read_table(spark, sf, "documents").select("doc_id", F.concat(pick, F.lit("\n"), "text").alias("text"))


def _literals(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CODE_DOCUMENTS_SQL = (f"SELECT doc_id, ({_literals(R.FIXTURE_CODE)})[doc_id % {len(R.FIXTURE_CODE)} + 1] || chr(10) || text "
                      "AS text FROM documents")


def task_notes(spark: SparkSession, sf: str) -> DataFrame:
    """`orders` with a task description by customer key."""
    notes = F.array(*[F.lit(c) for c in R.FIXTURE_TASK_NOTES])
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.element_at(
        notes, (F.pmod("o_custkey", F.lit(len(R.FIXTURE_TASK_NOTES))) + 1).cast("int")).alias("note"))


TASK_NOTES_SQL = (f"SELECT o_orderkey AS task_id, ({_literals(R.FIXTURE_TASK_NOTES)})"
                  f"[o_custkey % {len(R.FIXTURE_TASK_NOTES)} + 1] AS note FROM orders")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """`orders` as repository tasks: priority from the first character of
    o_orderpriority (1,2 -> 3; 3 -> 2; 4,5 -> 1), created_at = o_orderdate."""
    o = read_table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"),
                    F.when(p.isin("1", "2"), 3).when(p == "3", 2).otherwise(1).alias("priority"),
                    "o_totalprice", "o_orderstatus", "o_custkey")


TASKS_SQL = ("SELECT o_orderkey AS task_id, o_orderdate AS created_at, "
             "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 3 "
             "WHEN substr(o_orderpriority, 1, 1) = '3' THEN 2 ELSE 1 END AS priority, "
             "o_totalprice, o_orderstatus, o_custkey FROM orders")


def subtasks(spark: SparkSession, sf: str) -> DataFrame:
    """`lineitem` as allocations: parent = l_orderkey, weight = l_quantity,
    category from l_returnflag (A gpu, N cpu, R io). Every row is kept; the
    subtask id is the full row order within its parent (no unique key)."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("weight"), "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(F.col("l_returnflag") == "A", "gpu_tasks").when(F.col("l_returnflag") == "N", "cpu_tasks")
        .otherwise("io_tasks").alias("category"))


SUBTASKS_SQL = ("SELECT l_orderkey AS parent, l_linenumber, l_partkey, l_suppkey, l_quantity AS weight, "
                "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, "
                "CASE WHEN l_returnflag = 'A' THEN 'gpu_tasks' WHEN l_returnflag = 'N' THEN 'cpu_tasks' "
                "ELSE 'io_tasks' END AS category FROM lineitem")

# total order over lineitem rows (no unique key): every column
SUBTASK_ORDER = ["parent", "l_linenumber", "l_partkey", "l_suppkey", "weight", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def queue_log(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as a queue log: click/view enqueue (+1), purchase dequeue (-1),
    signup/error other (0); user_id mod 3 picks the queue."""
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", -1)
        .otherwise(0).alias("delta"),
        F.element_at(F.array(F.lit("gpu_queue"), F.lit("cpu_queue"), F.lit("io_queue")),
                     (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")).alias("queue"))


QUEUE_LOG_SQL = ("SELECT event_id, ts, user_id, event_type, value, props, "
                 "CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN -1 "
                 "ELSE 0 END AS delta, "
                 "CASE user_id % 3 WHEN 0 THEN 'gpu_queue' WHEN 1 THEN 'cpu_queue' ELSE 'io_queue' END AS queue "
                 "FROM events")


# Task parameters derived from each order (fixture binding for decomposition).
_TYPES = ["video", "ml", "financial", "image", "database"]
_RES = ["720p", "1080p", "4k", "8k", "480p"]
_MODELS = ["lightweight", "standard", "heavy", "transformer", "lstm"]
_CALCS = ["simple", "risk_assessment", "monte_carlo", "var_calculation", "other"]


def task_params(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    ck = F.col("o_custkey")

    def pick(values, idx):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))

    return o.select(
        F.col("o_orderkey").alias("task_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("data_processing"))
        .otherwise(pick(_TYPES, digit - 1)).alias("task_type"),
        (F.col("o_totalprice") / 1000).cast("long").alias("frame_count"),
        pick(_RES, F.pmod(ck, F.lit(5))).alias("resolution"),
        (F.lit(1) + F.pmod(ck, F.lit(8))).cast("int").alias("available_gpus"),
        (F.col("o_orderstatus") == "O").alias("has_audio"),
        F.col("o_totalprice").cast("long").alias("data_size"),
        pick([16, 32, 64, 128], F.pmod(ck, F.lit(4))).cast("long").alias("batch_size"),
        pick(_MODELS, F.pmod(ck, F.lit(5))).alias("model_type"),
        ((F.col("o_totalprice") / 1000).cast("long") + 1).alias("portfolio_size"),
        pick(_CALCS, F.pmod(ck, F.lit(5))).alias("calculation_type"),
        (F.lit(1) + F.pmod(ck, F.lit(16))).cast("int").alias("available_cpus"))


def _pick_sql(values, idx):
    vals = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{vals}])[({idx}) + 1]"


TASK_PARAMS_SQL = f"""SELECT o_orderkey AS task_id,
  CASE WHEN o_orderstatus = 'P' THEN 'data_processing'
       ELSE {_pick_sql(_TYPES, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")} END AS task_type,
  CAST(trunc(o_totalprice / 1000) AS BIGINT) AS frame_count,
  {_pick_sql(_RES, "o_custkey % 5")} AS resolution,
  CAST(1 + o_custkey % 8 AS INTEGER) AS available_gpus,
  o_orderstatus = 'O' AS has_audio,
  CAST(trunc(o_totalprice) AS BIGINT) AS data_size,
  CAST({_pick_sql([16, 32, 64, 128], "o_custkey % 4")} AS BIGINT) AS batch_size,
  {_pick_sql(_MODELS, "o_custkey % 5")} AS model_type,
  CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1 AS portfolio_size,
  {_pick_sql(_CALCS, "o_custkey % 5")} AS calculation_type,
  CAST(1 + o_custkey % 16 AS INTEGER) AS available_cpus
FROM orders"""
