"""Extension surface: plain DataFrame functions, registries, predictors, validators, R6."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alloc, dispatch, tasks
from corpusloom.streaming import jobs


def test_operators_compose_with_transform(spark):
    from corpusloom.operators import curate
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    out = df.transform(lambda d: curate.exact_dedupe(d, "text", ["id"]))
    assert sorted(r["id"] for r in out.collect()) == [1, 3]


def test_registries():
    assert tasks.strategy_for("image") == "video"
    assert tasks.strategy_for("database") == "financial"
    assert tasks.strategy_for("data_processing") == "generic"
    assert alloc.get_allocator("load_balanced") is alloc.allocate
    for name in alloc.NAMED_ONLY:
        with pytest.raises(NotImplementedError):
            alloc.get_allocator(name)
    with pytest.raises(KeyError):
        alloc.get_allocator("nope")


def test_predictor_plugin_and_validator(spark):
    rec = spark.createDataFrame([(1, "ohlcv", "{}"), (2, "social", "{}"), (3, "weird", "{}"), (4, None, "{}")],
                                "id long, data_type string, payload string")
    dmap = dispatch.dispatch_map(spark)
    routed = dispatch.route(rec, dmap)
    assert {r["data_type"] for r in dispatch.unrouted(rec, dmap).collect()} == {"weird"}
    dispatch.register_predictor("sentiment_model", lambda pdf: pdf["payload"].str.len().astype(str))
    out = {r["id"]: r["prediction"] for r in dispatch.batch_predict(routed).collect()}
    assert out == {1: "Prediction for ohlcv", 2: "2"}
    dispatch.PREDICTORS.clear()
    outputs = spark.createDataFrame([
        ('```json\n{"operation": "x", "steps": [{"step": 1, "action": "a", "expected_time": "1ms", "resource": "CPU"}]}```',),
        ('{"operation": "x", "steps": [{"step": "one", "action": "a", "expected_time": "1ms", "resource": "CPU"}]}',),
        ("not json",),
        ('{"steps": []}',)], "t string")
    v = [r[0] for r in outputs.select(dispatch.validate(F.col("t"), "decomposition")["valid"]).collect()]
    assert v == [True, False, False, False]


TASKS = ("task_id string, task_type string, frame_count long, resolution string, available_gpus int, "
         "has_audio boolean, data_size long, batch_size long, model_type string, portfolio_size long, "
         "calculation_type string, available_cpus int")


def _task_stream(spark, src, batches):
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, TASKS).coalesce(1).write.parquet(f"{src}/b={b}")
    return spark.readStream.schema(TASKS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def _task(i, kind, frames=None):
    return (i, kind, 100 if frames is None else frames, "1080p", 2, True, 1000, 32, "standard", 50, "simple", 4)


def test_micro_batch_allocation_claims_and_reports(spark, tmpdir_path):
    import os
    kinds = ["video", "ml", "financial", "data_processing"]
    batches = [[_task(f"t{b}{i}", k) for i, k in enumerate(kinds)] for b in range(3)]
    batches[1] += [_task("t00", "video"), _task(None, "video"), _task("bad", "video", -1000)]    # t00 is claimed by epoch 0
    stream = _task_stream(spark, os.path.join(tmpdir_path, "tasks"), batches)
    out = os.path.join(tmpdir_path, "out")
    q = jobs.micro_batch_allocation(spark, stream, out, name=f"alloc-{os.path.basename(tmpdir_path)}", assigned_to="d1") \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/allocated")
    assert got.select("epoch").distinct().count() == 3
    assert got.filter(F.col("alloc_rank") > 0).count() == got.count() > 0
    ids = sorted(f"t{b}{i}" for b in range(3) for i in range(4))
    claims = jobs.epoch_table(spark, out, "claims", jobs.CLAIMS).collect()
    assert sorted(r["task_id"] for r in claims) == ["bad", *ids] and {r["assigned_to"] for r in claims} == {"d1"}
    errors = {(r["task_id"], r["error"].split(":")[0]) for r in jobs.epoch_table(spark, out, "errors", jobs.ERRORS).collect()}
    assert errors == {(None, "no task id"), ("bad", "bad weight")}
    done = {r["task_id"]: r for r in jobs.epoch_table(spark, out, "completed", jobs.COMPLETED).collect()}
    assert sorted(done) == ids
    per_task = {r["task_id"]: r["count"] for r in got.groupBy("task_id").count().collect()}
    assert all(done[t]["subtasks_created"] == per_task.get(t, 0) for t in ids)
    assert done["t00"]["decomposition_strategy"] == "video" and "gpu_queue" in done["t00"]["queues_used"]
    assert got.where("task_id = 'bad'").count() == 0


def test_a_replayed_batch_counts_once(spark, tmpdir_path):
    """The sink fails after it has written an epoch's tables; the restarted query replays the batch."""
    import os
    src, out = os.path.join(tmpdir_path, "tasks"), os.path.join(tmpdir_path, "out")
    stream = _task_stream(spark, src, [[_task(f"t{b}{i}", "video") for i in range(2)] for b in range(2)])
    name = f"replay-{os.path.basename(tmpdir_path)}"
    writer = jobs.micro_batch_allocation(spark, stream, out, name=name)
    os.makedirs(out)
    open(f"{out}/commits", "w").close()            # a file where the commits' folder should be: the commit fails
    q = writer.trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination(300)
    assert spark.read.parquet(f"{out}/claims").count() == 2
    os.replace(f"{out}/commits", f"{out}/blocked")
    assert jobs.epoch_table(spark, out, "claims", jobs.CLAIMS).count() == 0          # not committed
    q = jobs.micro_batch_allocation(spark, stream, out, name=name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    claims = [r["task_id"] for r in jobs.epoch_table(spark, out, "claims", jobs.CLAIMS).collect()]
    assert sorted(claims) == ["t00", "t01", "t10", "t11"]
    done = jobs.epoch_table(spark, out, "completed", jobs.COMPLETED).collect()
    assert sorted(r["task_id"] for r in done) == sorted(claims) and all(r["subtasks_created"] > 0 for r in done)
