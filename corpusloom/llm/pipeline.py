"""The stages of the document pipeline and their run over a folder of tables.

Each stage takes the documents its predecessor kept and returns those it keeps, with
the columns of documents; the last adds their sampled pieces. Defined results for
nulls, empty and repeated rows are those of the operators: null texts count as
empty, null doc_ids are kept unless the text is rejected, and of an
empty table an empty one is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, shared_path
from .decontam import contamination
from .quality_gam import fit_quality, quality_score
from .simhash_dedup import one_of_each
from .sp_sampling import encode_sampled
from .toxic_segments import fit_toxic, toxic_score

LEAST_QUALITY = 0.3
MOST_TOXICITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't reject."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality_score(F.col("text"), model) >= LEAST_QUALITY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic passages enough to be rejected."""
    model = fit_toxic(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxic_score(F.col("text"), model) < MOST_TOXICITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every SimHash component."""
    return one_of_each(docs, k=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items.

    Whether a document is depends on its text alone, so doc_id and a hash of the text name it.
    """
    name = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    found = contamination(docs.select(name.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("doc_id.id", "doc_id.mark").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["mark"]), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces (ids), and whether these decode to the text (lossless)."""
    return encode_sampled(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=docs.columns)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("pieces", pieces)]

#: SQL can't express the trained and sampled stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
