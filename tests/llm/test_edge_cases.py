"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import brown_lm, decontam, fingerprints, lang_cnn, license_scan, pipeline, quality_gam
from corpusloom.llm import simhash_dedup, sp_sampling, token_counts, toxic_segments

LONG = "alpha beta gamma " * 20_000 + "x" * 50_000
ROWS = [
    (1, "Hello world, this is a text.\nLicensed under the MIT License.", "en", "s", 5),
    (1, "Hello world, this is a text.\nLicensed under the MIT License.", "en", "s", 5),      # a repeated row
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, "no id at all", "fr", "s", None),
    (4, " \n\t ", "en", "s", 3),
    (5, LONG, "en", "s", len(LONG)),
    (6, "Ünïcödé 日本語 🎉 ▁ <|endoftext|>", "de", "s", 1),
    (7, "1234 !!! ...", "en", "s", 1),
]
CLASHING = ("row", "score", "word", "n", "cell", "fp", "ids", "term", "held_out", "paragraph", "y", "_p", "lossless")


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (5, None, 1), (None, 1, 1), (77, 0, 0), (6, 0, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "hello world this"), (1, None), (None, "no id at all"), (2, ""), (3, "absent words")],
                                 "item_id long, text string")


def operators(docs, labels, benchmark):
    bpe, sp = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return {
        "tokens": lambda: token_counts.token_counts(docs, bpe),
        "lm": lambda: brown_lm.language_model_scores(docs),
        "toxic": lambda: toxic_segments.score_toxic(docs, toxic_segments.fit_toxic(docs, labels)),
        "simhash": lambda: simhash_dedup.near_duplicates(docs),
        "fingerprints": lambda: fingerprints.document_fingerprints(docs),
        "lang": lambda: lang_cnn.predict_langs(docs, lang_cnn.fit_langs(docs)),
        "pieces": lambda: sp_sampling.encode_sampled(docs, sp),
        "decontam": lambda: decontam.contamination(docs, benchmark),
        "quality": lambda: quality_gam.score_quality(docs, quality_gam.fit_quality(docs, labels)),
    }


NAMES = ["tokens", "lm", "toxic", "simhash", "fingerprints", "lang", "pieces", "decontam", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(name, messy, labels, benchmark):
    rows = operators(messy, labels, benchmark)[name]().collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    first, second = [r for r in rows if r["doc_id"] == 1]
    if name != "fingerprints":      # a repeated row is its repeat's next document
        assert first == second
    by = {r["doc_id"]: r for r in rows}
    if name == "tokens":
        assert by[2]["n_bytes"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and not by[2]["over_limit"]
        assert by[5]["over_limit"]
    if name == "lm":
        assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1
        assert by[5]["n_tokens"] == 60_002
    if name == "simhash":
        assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
        assert by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
        assert by[None]["component_id"] is None
    if name == "lang":
        assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[7]["lang_pred"] == "und"
    if name == "pieces":
        assert by[2]["ids"] is None and by[3]["ids"] == [] and all(r["lossless"] for r in rows)
    if name == "decontam":
        assert by[2]["n_words"] == by[3]["n_words"] == 0
        assert (by[1]["n_hit"], by[1]["n_items"]) == (3, 1)
        assert (by[None]["n_hit"], by[None]["n_items"], by[None]["contaminated"]) == (4, 0, True)
    if name == "fingerprints":
        assert by[2]["n_chars"] == 0 and by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 64
    if name in ("toxic", "quality"):
        assert by[2]["score"] == by[3]["score"] and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, messy, labels, benchmark):
    none = messy.where("false")
    assert operators(none, labels.where("false"), benchmark.where("false"))[name]().collect() == []


def test_no_labels(messy, labels, benchmark):
    quality, toxic = (operators(messy, labels.where("false"), benchmark)[n]().collect() for n in ("quality", "toxic"))
    assert {r["score"] for r in quality} == {0.5}
    assert max(r["score"] for r in toxic) < 1e-6


def test_licences(messy):
    found = license_scan.find_licenses(messy, license_scan.fit_licenses(messy)).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in found) == [(1, 1, "MIT")] * 2


def test_licences_of_nothing(messy):
    none = messy.where("false")
    assert license_scan.find_licenses(none, license_scan.fit_licenses(none)).collect() == []


def test_pipeline_stages(spark, messy, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = messy
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "pieces":
            assert docs.columns == messy.columns
    kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and docs.columns[-2:] == ["ids", "lossless"]
