"""The numbered queries of this subpackage over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .brown_lm import language_model_scores
from .common import read_table
from .decontam import contamination, contamination_sql
from .fingerprints import document_fingerprints
from .lang_cnn import fit_langs, predict_langs
from .license_scan import find_licenses, fit_licenses
from .merkle_manifest import verified_documents, verified_documents_sql
from .quality_gam import fit_quality, score_quality
from .simhash_dedup import near_duplicates
from .sp_sampling import encode_sampled
from .token_counts import token_counts
from .toxic_segments import fit_toxic, score_toxic
from .vector_codes import compressed_vectors, compressed_vectors_sql
from .warc_bundles import archived_pages, archived_pages_sql

Query = Callable[[SparkSession, str], DataFrame]

#: Longest text, in tokens, that a model of this pipeline takes whole.
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under byte_bpe_50k.json."""
    return token_counts(read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based language-model score of every document."""
    return language_model_scores(read_table(spark, sf_dir, "documents"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by its maximum-scoring segments."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxic(docs, fit_toxic(docs, labels))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence paragraph of the documents with its family."""
    docs = read_table(spark, sf_dir, "documents")
    return find_licenses(docs, fit_licenses(docs))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of the documents: shingles of 4 words, at most 4 differing bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, max_bits=4)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with near documents of every hundredth."""
    return document_fingerprints(read_table(spark, sf_dir, "documents"))


def op7_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte convolutional network."""
    docs = read_table(spark, sf_dir, "documents")
    return predict_langs(docs, fit_langs(docs))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: their number, a digest of their ids, and whether they decode to the text."""
    encoded = encode_sampled(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                          F.lower(F.hex(F.xxhash64("ids"))).alias("ids_xxh64"), "lossless")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of benchmark items, and its proximity matches."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), proximity=True)


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the additive model."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, fit_quality(docs, labels))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector by product codebooks with equal-average search."""
    return compressed_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into seekable bundles and read back."""
    return archived_pages(spark, read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the Merkle manifest, and what it says of a tampered copy."""
    return verified_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_brown_lm": op2_brown_lm,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_cnn": op7_language_cnn,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_quality_gam": op10_quality_gam,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op9_decontamination": contamination_sql(),
    "op11_vector_codes": compressed_vectors_sql(),
    "op12_warc_bundles": archived_pages_sql(),
    "op13_merkle_manifest": verified_documents_sql(),
}
