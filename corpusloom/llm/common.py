"""Helpers the operators of this subpackage share: keys, samples and shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, read_table


def crc_mod(col: str | Column, k: int) -> Column:
    """crc32 of a value's text, modulo k; -1 for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(k), F.lit(-1).cast("long"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int,
                    fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled texts for fitting: columns doc_id, text, y.

    Rows with ``crc32(doc_id) mod modulus == left_out`` are never used. The rows are
    the first ones by a hash of doc_id, so the choice does not depend on row order;
    of repeated label rows the larger value counts. Null ids, labels and texts are skipped, and
    labels of ids without a text take no place.
    """
    there = docs.where("text is not null and doc_id is not null").select("doc_id").distinct()
    picked = (labels.join(there, "doc_id", "left_semi").select("doc_id", F.col(label).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
              .where(crc_mod("doc_id", modulus) != left_out)
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # at most fit_rows pairs of a long and an int: a bounded table
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")


__all__ = ["crc_mod", "shared_path", "shared_table", "labelled_sample", "read_table", "checkpoint_dir"]
