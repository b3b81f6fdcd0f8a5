"""Session helpers: building a local session for tests and reading tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session with the settings the jobs assume (AQE on, UTC, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is. Only
    in local mode, when it is unset, a fresh scratch folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read once, as Parquet in the shared folder, and read it back.

    Cuts the lineage with files that survive the loss of an executor. Runs a job.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: bytes of an Arrow batch that goes to a Python worker, at most
BATCH_BYTES = 2 << 20


def small_batches(table: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """``table``, its session set to Arrow batches of at most ``size`` bytes (a smaller setting is kept).

    Spark's default is 64 MB. As Python strings, and the results beside them, that is several
    times as much for each worker, and a chain of functions has several workers a core.
    """
    conf, key = table.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key) or "").lower().removesuffix("b")
    now = int(now) if now.isdigit() else 0      # with a unit, or none: not known to be smaller
    if not 0 < now <= size:
        conf.set(key, size)
    return table


def spread(table: DataFrame) -> DataFrame:
    """A table for work that is heavy per row: dealt out if its files make fewer splits than there are cores.

    A small file of one row group is one task however many cores there are. Tables with more
    files than cores are left as they are, so no large table is shuffled for it.
    """
    files, cores = len(table.inputFiles()), table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if 0 < files < cores and table.rdd.getNumPartitions() < cores else table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
