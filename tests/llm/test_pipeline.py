import corpus_pipeline
from corpusloom.llm import decontam, quality_gam, simhash_dedup, toxic_segments
from tests.conftest import SF001


def test_each_stage_does_its_operators_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("labels", "benchmark"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, path = docs, str(tmp_path / name)
        stage(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            rows = quality_gam.score_quality(before, quality_gam.fit_quality(before, labels)).where("predicted = 1")
        elif name == "toxicity":
            rows = toxic_segments.score_toxic(before, toxic_segments.fit_toxic(before, labels)).where("predicted = 0")
        elif name == "near_dedup":
            rows = simhash_dedup.near_duplicates(before).where("doc_id = component_id")
        elif name == "decontaminate":
            rows = decontam.contamination(before, bench).where("not contaminated")
        else:
            rows = before
        assert kept[name] == {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert docs.columns == columns + ["ids", "lossless"] and docs.where("not lossless").count() == 0
    result = corpus_pipeline.run(spark, SF001)
    assert {r["doc_id"] for r in result.select("doc_id").collect()} == kept["pieces"]


def test_run_on_empty_and_messy_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "Hello world, this is a text.", "en", "s", 28), (1, "Hello world, this is a text.", "en", "s", 28), (2, None, None, None, None),
            (None, "no id at all", "fr", "s", 12), (3, "", "en", None, 0), (4, "x" * 30_000, "en", "s", 30_000)]
    for name, data in (("empty", []), ("messy", rows)):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).selectExpr("*", "1 AS _simhash_row0", "'k' AS score").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(got) == (0 if name == "empty" else len({r["doc_id"] for r in got})) and all(r["score"] == "k" for r in got)
        assert all(r["lossless"] for r in got)
