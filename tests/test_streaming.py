"""Each streaming twin equals its batch twin on sf0.001 events split into daily files."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import alloc_q
from corpusloom.streaming import jobs
from tests.conftest import SF001


@pytest.fixture(scope="module")
def stream_dir(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="corpusloom-stream-")
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn("day", F.to_date("ts"))
    days = sorted(r["day"] for r in ev.select("day").distinct().collect())
    for i, day in enumerate(days):
        ev.filter(F.col("day") == day).drop("day").coalesce(1).write.parquet(os.path.join(d, f"part={i:03d}"))
    return d


def _run(spark, sdf, name, mode="append"):
    import uuid

    from corpusloom.session import checkpoint_dir
    # a fresh checkpoint per run: the shared checkpoint folder outlives test sessions
    q = (sdf.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex}")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name)


def _events(spark, stream_dir):
    return jobs.read_events(spark, f"{stream_dir}/*", max_files_per_trigger=8)


@pytest.fixture(scope="module")
def closed_dir(spark, stream_dir):
    """Days cut so that each file holds events of two days, and two later files that move the watermark past all."""
    import tempfile
    d = tempfile.mkdtemp(prefix="corpusloom-closed-")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    t = F.col("ts").cast("timestamp")
    first = ev.agg(F.min(t)).first()[0]
    hours = ((F.unix_micros(t) - F.unix_micros(F.lit(first))) / 3_600_000_000).cast("long")
    # every third event comes up to 20 hours late: it is in a later file than newer events
    part = F.floor((hours + F.when(F.col("event_id") % 3 == 0, F.pmod(F.col("event_id"), F.lit(20))).otherwise(0)) / 96)
    n = int(ev.select(F.max(part)).first()[0])
    for i in range(n + 1):
        ev.where(part == i).coalesce(1).write.parquet(os.path.join(d, f"part={i:03d}"))
    end = ev.limit(3).select(
        (F.lit(-1) - F.monotonically_increasing_id()).alias("event_id"),
        F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    end.coalesce(1).write.parquet(os.path.join(d, f"part={n + 1:03d}"))
    return d


def _late(spark, closed_dir):
    return jobs.read_events(spark, f"{closed_dir}/*", max_files_per_trigger=1)


def test_funnel_stream(spark, stream_dir):
    got = _run(spark, jobs.funnel_counts(_events(spark, stream_dir)), "funnel_q", "complete")
    want = spark.read.parquet(f"{SF001}/events.parquet").groupBy(F.col("user_id").alias("producer")).count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_tumbling_stream_closed_windows(spark, stream_dir):
    got = _run(spark, jobs.metrics_tumbling(_events(spark, stream_dir)), "tumble")
    batch = alloc_q.metrics_tumbling(spark, SF001)
    g = {(r["window_start"], r["queue"]): r["n"] for r in got.collect()}
    b = {(r["window_start"], r["queue"]): r["n"] for r in batch.collect()}
    assert g and all(b[k] == v for k, v in g.items())
    assert len(g) >= len(b) - 3  # windows still open at the end are not emitted in append mode


def test_flow_control_stream(spark, closed_dir):
    """Late events, within the watermark's delay, give what the batch gives."""
    got = _run(spark, jobs.flow_control(_late(spark, closed_dir), 40, alloc_q.FIXTURE_QUEUES, "30 hours"), "flow")
    want = alloc_q.flow_control_state(spark, SF001)
    assert {tuple(r) for r in got.where("event_id >= 0").collect()} == {tuple(r) for r in want.collect()}


def test_admission_stream(spark, stream_dir):
    got = _run(spark, jobs.bounded_admission(_events(spark, stream_dir), alloc_q.RING_CAPACITY), "adm")
    want = alloc_q.bounded_admission(spark, SF001)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_rate_limit_and_ttl_stream(spark, closed_dir):
    ev = _late(spark, closed_dir)
    got = _run(spark, jobs.greedy_gap(ev, "queue", alloc_q.RATE_GAP_SECONDS, True, "accepted", "30 hours"), "rate")
    want = alloc_q.rate_limit_accept(spark, SF001)
    assert {tuple(r) for r in got.where("event_id >= 0").collect()} == {tuple(r) for r in want.collect()}
    got = _run(spark, jobs.greedy_gap(_late(spark, closed_dir), "user_id", alloc_q.TTL_SECONDS, False, "inserted",
                                      "30 hours"), "ttl")
    want = alloc_q.ttl_cache_hits(spark, SF001)
    g = {(r["user_id"], r["event_id"], not r["inserted"]) for r in got.where("event_id >= 0").collect()}
    assert g == {tuple(r) for r in want.collect()}


def test_history_stream(spark, closed_dir):
    """Late events, within the delay, give the histories of the batch."""
    got = _run(spark, jobs.recent_history(_late(spark, closed_dir), alloc_q.HISTORY_N, "30 hours"), "hist")
    rows = got.where("newest >= 0").collect()
    ts = {r["event_id"]: r["ts"] for r in spark.read.parquet(f"{SF001}/events.parquet").collect()}
    last = {}
    for r in rows:
        last[r["user_id"]] = max(last.get(r["user_id"], (ts[r["newest"]], r["newest"])), (ts[r["newest"]], r["newest"]))
    final = {(r["user_id"], r["event_id"]) for r in rows if r["newest"] == last[r["user_id"]][1]}
    want = {tuple(r) for r in alloc_q.recent_history(spark, SF001).collect()}
    assert final == want


def _log(spark, tmp_path, batches):
    """Small event files, one per trigger: (event_id, seconds, user_id)."""
    for i, batch in enumerate(batches):
        (spark.createDataFrame([(e, s, u) for e, s, u in batch], "event_id long, s long, user_id long")
         .select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("click").alias("event_type"),
                 F.lit(1.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/part={i:03d}"))
    return jobs.read_events(spark, f"{tmp_path}/*", max_files_per_trigger=1)


def test_history_order_late_events_and_released_keys(spark, tmp_path):
    import uuid

    from corpusloom.session import checkpoint_dir
    # event 3 comes a file later than event 4 but before it in time; event 9 is later than the delay and dropped
    stream = _log(spark, tmp_path, [[(1, 10, 7), (4, 40, 7)], [(3, 30, 7), (2, 20, 7)], [(50, 5000, 8)], [(53, 5001, 8)], [(9, 35, 7)], [(51, 9000, 8)], [(52, 9001, 8)]])
    q = (jobs.recent_history(stream, 3, "60 seconds", idle="1000 seconds").writeStream.format("memory").queryName("order_q")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/test-order-{uuid.uuid4().hex}").trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = [r for r in spark.table("order_q").collect() if r["user_id"] == 7]
    last = [r["event_id"] for r in rows if r["newest"] == 4]
    assert last == [2, 3, 4] and all(r["newest"] != 9 for r in rows)
    # the idle producer is released; what is left is producer 8's
    assert q.recentProgress[-1]["stateOperators"][0]["customMetrics"] is not None
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"])
    assert removed > 0


def test_a_batch_rewrites_only_the_slots_it_touches(spark, tmp_path):
    """A thousand waiting events of one key; a batch of one event writes one slot, not all."""
    import uuid

    from corpusloom.session import checkpoint_dir
    stream = _log(spark, tmp_path, [[(i, i, 3) for i in range(1000)], [(5000, 1001, 3)], [(5001, 1002, 3)]])
    q = (jobs.recent_history(stream, 3, "10000 seconds").writeStream.format("memory").queryName("slots_q")
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/test-slots-{uuid.uuid4().hex}").trigger(availableNow=True).start())
    q.awaitTermination(300)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(updated) == 3 and max(updated[1:]) <= 4


def test_urls_once_within_the_watermark(spark, tmp_path):
    """As the batch within the delay; a repeat after it comes through again."""
    from corpusloom.operators.pages import dedupe_by
    rows = [[(1, 0, "http://a/x?q=1"), (2, 5, "http://a/y")], [(3, 20, "http://a/x#top"), (4, 30, "http://a/z")],
            [(5, 1000, "http://a/w")], [(6, 1001, "http://a/v")], [(7, 1002, "http://a/x")]]
    for i, batch in enumerate(rows):
        (spark.createDataFrame(batch, "page_id long, s long, url string").select("page_id", "url", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"))
         .coalesce(1).write.parquet(f"{tmp_path}/part={i:03d}"))
    stream = (spark.readStream.schema("page_id long, url string, ts timestamp").option("maxFilesPerTrigger", 1)
              .parquet(f"{tmp_path}/*"))
    got = sorted(r["page_id"] for r in _run(spark, jobs.distinct_urls(stream, delay="60 seconds"), "urls").collect())
    pages = spark.createDataFrame([r for b in rows for r in b], "page_id long, s long, url string").withColumn(
        "key", F.regexp_replace("url", "[?#].*$", ""))
    batch = sorted(r["page_id"] for r in dedupe_by(pages, "key", ["page_id"]).collect())
    assert batch == [1, 2, 4, 5, 6] and got == [*batch, 7]


def test_funnel_of_several_producers(spark, tmp_path):
    """The observed totals are the batch's counts."""
    import time
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    for k in range(3):
        for part in range(2):
            ev.where((F.col("user_id") % 3 == k) & (F.col("event_id") % 2 == part)).coalesce(1).write.parquet(f"{tmp_path}/p{k}/part={part}")
    totals = jobs.FunnelTotals()
    spark.streams.addListener(totals)
    try:
        streams = {f"p{k}": jobs.read_events(spark, f"{tmp_path}/p{k}/*") for k in range(3)}
        got = _run(spark, jobs.funnel(streams), "funnel_many")
        want = {f"p{r['k']}": r["count"] for r in ev.groupBy((F.col("user_id") % 3).alias("k")).count().collect()}
        assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == want
        for _ in range(50):             # progress events come from a thread of their own
            if totals.total() == sum(want.values()):
                break
            time.sleep(0.2)
        assert totals.rows == want and totals.batches >= 2
    finally:
        spark.streams.removeListener(totals)
