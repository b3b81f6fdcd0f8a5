"""Structured Streaming twins of the queue/log operators.

Sources are file streams (parquet) read with an explicit schema; event time
is cast from TIMESTAMP_NTZ to TIMESTAMP before watermarks. Stateful folds use
``transformWithStateInPandas`` keyed by queue / producer / cache key: the fold's
carry (a flag, a time, or the last N ids), the events of the watermark's delay
by time slot, and timers, in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom import rules as R
from corpusloom.session import checkpoint_dir
from corpusloom.sources.readers import _empty_if_missing

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream; the queue-log binding columns are added."""
    s = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
         .parquet(path))
    return s.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", -1)
        .otherwise(0).alias("delta"),
        F.element_at(F.array(F.lit("gpu_queue"), F.lit("cpu_queue"), F.lit("io_queue")),
                     (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")).alias("queue"))


def funnel_counts(events: DataFrame) -> DataFrame:
    """Items per producer (complete mode); the stream's progress reports
    the total throughput (numInputRows per micro-batch)."""
    return events.groupBy(F.col("user_id").alias("producer")).agg(F.count(F.lit(1)).alias("n_items"))


def metrics_tumbling(events: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """R2: per (tumbling window, queue) counts; append mode emits closed windows."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "queue")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
            .select(F.col("w.start").alias("window_start"), "queue", "n", "total_value"))


def _sorted(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(list(pdfs), ignore_index=True)
    return pdf.sort_values(["ts", "event_id"], kind="mergesort")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "ts_us array<long>, ids array<long>, vals array<double>"


class EventTimeFold(StatefulProcessor):
    """A fold over each key's events in event-time order.

    Events wait in a map state, by time slot, until the watermark has passed their slot; a timer at the slot's end
    then folds it in (time, id) order, so the result doesn't depend on how the events came in. A batch rewrites
    only the slots that got events, never all that wait. ``fold(carry, ts_us, ids, vals)`` returns the new carry (a tuple, or
    None) and the output columns. A key with no waiting events whose carry ``expires`` (carry -> microseconds) is
    released by a timer of its own.
    """

    def __init__(self, key: str, names: list[str], carry: str, fold, expires, slot_ms: int):
        self.key, self.names, self.schema, self.fold, self.expires, self.slot_ms = key, names, carry, fold, expires, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", _ROWS)
        self.open_carry(handle)

    def open_carry(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", self.schema)

    def get_carry(self):
        return self.carry.get() if self.carry.exists() else None

    def put_carry(self, held) -> None:
        self.carry.update(held)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            slots = pdf["ts_us"].to_numpy() // (self.slot_ms * 1000)
            for slot, part in pdf.groupby(slots):
                at = (int(slot),)
                old = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([], [], [])
                self.waiting.updateValue(at, (list(old[0]) + part["ts_us"].tolist(), list(old[1]) + part["event_id"].tolist(),
                                              list(old[2]) + part["val"].astype(float).tolist()))
                if not old[0]:
                    self.handle.registerTimer((int(slot) + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        slots = sorted(k[0] for k in self.waiting.keys())
        due = [k for k in slots if (k + 1) * self.slot_ms <= now]
        held = self.get_carry()
        for slot in due:
            ts, ids, vals = (np.asarray(x, dtype=t) for x, t in zip(self.waiting.getValue((slot,)), (np.int64, np.int64, float)))
            order = np.lexsort((ids, ts))
            held, columns = self.fold(held, ts[order], ids[order], vals[order])
            self.waiting.removeKey((slot,))
            yield self.result(key, ids[order], columns)
        if due and held is not None:
            self.put_carry(held)
        end = None if held is None or self.expires is None else self.expires(held) // 1000 + 1
        if end is None:
            return
        if end > now:
            if due:
                self.handle.registerTimer(end)
        elif len(due) == len(slots):
            self.carry.clear()

    def result(self, key, ids: np.ndarray, columns) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(ids), **dict(zip(self.names, (ids, *columns)))})

    def close(self) -> None:
        pass


def _seconds(delay: str) -> float:
    return pd.Timedelta(delay).total_seconds()


def in_event_time(events: DataFrame, key: str, value: str, out: str, delay: str, make) -> DataFrame:
    """The fold of ``make(key, names, slot_ms)`` over a stream's events, those later than ``delay`` dropped.

    State lies in RocksDB, so keys and waiting events aren't held in memory; a slot is a sixteenth of the delay.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [c.split()[0] for c in out.split(", ")]
    rows = (events.withWatermark("ts", delay)
            .select("ts", key, F.unix_micros("ts").alias("ts_us"), "event_id", F.col(value).cast("double").alias("val")))
    return rows.groupBy(key).transformWithStateInPandas(
        make(key, names, max(1, int(_seconds(delay) * 1000 / 16))), f"{key} {dict(events.dtypes)[key]}, {out}", "append", "EventTime")


def flow_control(events: DataFrame, depth_factor: float, config, delay: str = "1 hour") -> DataFrame:
    """W10 online. State per queue: the current on/off flag and the events waiting for the watermark."""
    limits = {q: (d * t, d * R.FLOW_RELEASE_FRACTION) for q, d, _b, t, *_ in config}
    high = F.create_map(*[x for q, (h, _) in limits.items() for x in (F.lit(q), F.lit(float(h)))])
    low = F.create_map(*[x for q, (_, v) in limits.items() for x in (F.lit(q), F.lit(float(v)))])
    depth = F.floor(F.col("value") * depth_factor)
    signal = (F.when(depth > high[F.col("queue")], 1.0).when(depth < low[F.col("queue")], 0.0).otherwise(-1.0))

    def fold(carry, ts, ids, vals):
        # the last signal so far; before any, what was carried in
        at = np.maximum.accumulate(np.where(vals >= 0, np.arange(len(vals)), -1))
        start = bool(carry[0]) if carry else False
        on = np.where(at >= 0, vals[np.maximum(at, 0)] > 0, start)
        return (bool(on[-1]),), (on,)

    return in_event_time(events.withColumn("signal", signal), "queue", "signal", "event_id long, flow_control boolean", delay,
                         lambda key, names, slot: EventTimeFold(key, names, "on boolean", fold, None, slot))


def bounded_admission(events: DataFrame, capacity: int) -> DataFrame:
    """R4 (W12 online): state per queue is the current depth."""
    cap = 1
    while cap < capacity:
        cap <<= 1
    usable = cap - 1

    def step(key, pdfs, state: GroupState):
        queue = key[0]
        depth = state.get[0] if state.exists else 0
        pdf = _sorted(pdfs)
        out = []
        for eid, d in zip(pdf["event_id"], pdf["delta"]):
            rejected = False
            if d > 0:
                if depth >= usable:
                    rejected = True
                else:
                    depth += 1
            elif d < 0 and depth > 0:
                depth -= 1
            out.append((queue, int(eid), depth, rejected))
        state.update((depth,))
        yield pd.DataFrame(out, columns=["queue", "event_id", "depth_after", "rejected"])

    return events.groupBy("queue").applyInPandasWithState(
        step, "queue string, event_id long, depth_after long, rejected boolean", "depth long", "append",
        GroupStateTimeout.NoTimeout)


def greedy_gap(events: DataFrame, key: str, gap_seconds: float, inclusive: bool, out: str,
               delay: str = "1 hour") -> DataFrame:
    """R4 rate limit (``inclusive``: accept when gap >= 1/rate) and R5 TTL cache
    (not inclusive: re-insert when age > ttl). State per key: the time of the
    last accepted / inserted item and the events waiting for the watermark; the key is
    released once the gap has passed. The comparison uses the rows' event time."""
    gap = int(gap_seconds * 1_000_000) + (0 if inclusive else 1)

    def fold(carry, ts, ids, vals):
        ok = np.zeros(len(ts), dtype=bool)
        last = carry[0] if carry else None
        i = 0 if last is None else int(np.searchsorted(ts, last + gap))
        while i < len(ts):          # from one accepted item to the next
            ok[i], last = True, int(ts[i])
            i = max(int(np.searchsorted(ts, last + gap)), i + 1)
        return (last,), (ok,)

    return in_event_time(events.withColumn("nothing", F.lit(0.0)), key, "nothing", f"event_id long, {out} boolean", delay,
                         lambda k, names, slot: EventTimeFold(k, names, "last_us long", fold, lambda c: c[0] + gap, slot))


class HistoryFold(EventTimeFold):
    """The last n ids of each key as a list state, oldest first, and the time of the newest."""

    def __init__(self, key: str, names: list[str], n: int, idle_us: int | None, slot_ms: int):
        super().__init__(key, names, "", self.extend, None if idle_us is None else (lambda c: c[1] + idle_us), slot_ms)
        self.n = n

    def open_carry(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getListState("history", "event_id long, ts_us long")

    def get_carry(self):
        rows = list(self.carry.get()) if self.carry.exists() else []
        return ([r[0] for r in rows], rows[-1][1]) if rows else None

    def put_carry(self, held) -> None:
        self.carry.put([(int(i), int(held[1])) for i in held[0]])

    def extend(self, held, ts, ids, vals):
        history = ((held[0] if held else []) + ids.tolist())[-self.n:]
        return (history, int(ts[-1])), (history,)

    def result(self, key, ids: np.ndarray, columns) -> pd.DataFrame:
        history, = columns
        return pd.DataFrame({self.key: [key[0]] * len(history), "event_id": history, "slot": range(len(history)),
                             "newest": [int(ids[-1])] * len(history)})


def recent_history(events: DataFrame, n: int = 5, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """R8 (W17 online): the last n event ids per producer in event-time order, emitted whenever the watermark closes a
    time slot of the producer; ``newest`` names the event it stands at. A producer without events for ``idle`` is
    released (None: never), and begins anew after that."""
    idle_us = None if idle is None else int(_seconds(idle) * 1_000_000)
    return in_event_time(events.withColumn("nothing", F.lit(0.0)), "user_id", "nothing", "event_id long, slot int, newest long",
                         delay, lambda key, names, slot: HistoryFold(key, names, n, idle_us, slot))


def distinct_urls(pages: DataFrame, url: str = "url", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """F6 online: a URL (without query and fragment) is passed on once; it is remembered for ``delay`` of event time.

    State holds a key for each URL of the delay alone, in RocksDB; a repeat after it comes through again.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (pages.withColumn("_key", F.regexp_replace(url, "[?#].*$", "")).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark(["_key"]).drop("_key"))


def funnel(sources: dict[str, DataFrame]) -> DataFrame:
    """The streams of several producers as one, each counted as it enters (``observe``).

    All have the same columns; ``source`` names the producer. `FunnelTotals` adds the counts up.
    """
    streams = [df.observe(f"funnel-{name}", F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(name))
               for name, df in sources.items()]
    out = streams[0]
    for df in streams[1:]:
        out = out.unionByName(df)
    return out


class FunnelTotals(StreamingQueryListener):
    """Rows of every producer of `funnel` and of the whole, over the micro-batches of a query so far."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = {name: row["rows"] for name, row in event.progress.observedMetrics.items() if name.startswith("funnel-")}
        self.batches += bool(found)
        for name, rows in found.items():
            name = name.removeprefix("funnel-")
            self.rows[name] = self.rows.get(name, 0) + rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self) -> int:
        return sum(self.rows.values())


def epoch_table(spark: SparkSession, out_dir: str, table: str, schema, finished: bool = True) -> DataFrame:
    """A table that `micro_batch_allocation` writes; by default without the epochs that have no commit yet."""
    def read(name, kind):
        return _empty_if_missing(lambda: spark.read.schema(kind).option("basePath", f"{out_dir}/{name}")
                                 .parquet(f"{out_dir}/{name}"), spark, f"{out_dir}/{name}", kind)

    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = read(table, T.StructType([*fields.fields, T.StructField("epoch", T.LongType())]))
    return rows.join(read("commits", "epoch long").select("epoch").distinct(), "epoch", "left_semi") if finished else rows


CLAIMS = "task_id string, assigned_to string"
COMPLETED = "task_id string, subtasks_created long, queues_used array<string>, decomposition_strategy string"
ERRORS = "task_id string, error string"


def micro_batch_allocation(spark: SparkSession, tasks_stream: DataFrame, out_dir: str, name: str = "alloc",
                           assigned_to: str = "decomposer"):
    """Claim a batch of tasks -> decompose -> map to queues -> allocate -> report, per micro-batch.

    Every table has a folder per epoch that a repeated epoch overwrites, and a commit row ends the epoch, so a batch
    that is replayed after a failure counts once. ``claims``: the tasks with their decomposer; a task
    that an earlier epoch has claimed is left out. ``allocated``: subtasks with their rank in the queue. ``completed``: per
    task the subtasks allocated, the queues used and the strategy. ``errors``: tasks without an id, or of which
    a subtask has no weight or a negative one; none of their subtasks is allocated.
    """
    from corpusloom.operators import alloc, tasks

    def run(batch: DataFrame, epoch: int):
        session = batch.sparkSession

        def put(df: DataFrame, table: str) -> DataFrame:
            path = f"{out_dir}/{table}/epoch={epoch}"
            df.write.mode("overwrite").parquet(path)
            return session.read.schema(df.schema).parquet(path)

        before = epoch_table(session, out_dir, "claims", CLAIMS, finished=False).where(F.col("epoch") < epoch)
        named = batch.where("task_id is not null").dropDuplicates(["task_id"])
        fresh = named.join(before.select("task_id"), "task_id", "left_anti")
        claims = put(fresh.select("task_id", F.lit(assigned_to).alias("assigned_to")), "claims")
        fresh = named.join(claims.select("task_id"), "task_id", "left_semi")
        sub = put(tasks.queue_mapping(tasks.decompose(fresh)), "subtasks")
        failed = sub.where("weight is null or weight < 0").groupBy("task_id").agg(
            F.concat(F.lit("bad weight: "), F.min("subtask_id")).alias("error"))
        errors = put(failed.union(batch.where("task_id is null").select("task_id", F.lit("no task id").alias("error"))), "errors")
        ok = sub.join(errors.select("task_id"), "task_id", "left_anti")
        depth = ok.groupBy(F.col("target_queue").alias("queue")).agg(F.count(F.lit(1)).alias("depth"))
        allocated = put(alloc.allocate(ok.withColumn("flow_control_priority", F.col("priority")),
                                       alloc.queue_config(session), depth, ["task_id", "subtask_id"]), "allocated")
        put(ok.select("task_id", "strategy").distinct().join(
            allocated.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("target_queue")).alias("q")),
            "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).alias("subtasks_created"),
                                      F.coalesce("q", F.array().cast("array<string>")).alias("queues_used"),
                                      F.col("strategy").alias("decomposition_strategy")), "completed")
        session.range(epoch, epoch + 1).select(F.col("id").alias("epoch")).coalesce(1).write.mode("overwrite").parquet(
            f"{out_dir}/commits/batch={epoch}")

    ckpt = f"{checkpoint_dir(spark)}/stream-{name}"
    return tasks_stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
