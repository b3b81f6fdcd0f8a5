"""The labelled sample: only ids with a text take a place."""

from corpusloom.llm.common import labelled_sample


def test_labels_without_a_text_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 10 == 0 else None) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(0, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 3, 1, 12).collect()
    assert len(rows) == 12 and all(r["doc_id"] % 10 == 0 and r["text"] for r in rows)
    assert [r["y"] for r in labelled_sample(docs, labels, "toxic", 3, 5, 1000).where("doc_id = 0").collect()] == [1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 3, 1, 12).collect() == []
