import numpy as np

from corpusloom.llm import lang_cnn as L


def test_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    model = L.train(rng.integers(0, 255, (60, L.WINDOW), dtype=np.uint8), rng.integers(0, 3, 60), ["a", "b", "c"])
    x = rng.integers(0, 255, (4, L.WINDOW), dtype=np.uint8)
    pooled = []
    for bank, bias in zip(model.banks, model.biases):
        out = [[(model.embedding[row[i:i + len(bank)]][:, :, None] * bank).sum(axis=(0, 1))
                for i in range(L.WINDOW - len(bank) + 1)] for row in x]
        pooled.append(np.maximum(np.array(out).max(axis=1) + bias, 0))
    assert np.allclose(model.logits(x), np.concatenate(pooled, axis=1) @ model.out + model.out_bias, atol=1e-4)


def test_windows_cover_the_whole_text():
    text = "word " * 1000
    w = L.window_bytes(text)
    assert bytes(w.reshape(-1)).decode().rstrip() == text.rstrip() and L.window_bytes(None).shape == (1, L.WINDOW)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = (L.predict_langs(docs, L.fit_langs(docs)).where("held_out")
            .join(docs.select("doc_id", "lang"), "doc_id").collect())
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some words here", "xx") for i in range(40)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.predict_langs(docs, L.fit_langs(docs)).collect()} == {"xx"}


def test_signs_that_are_numbers_are_no_letters(spark):
    assert not any(map(L.has_letter, ["½ ²³ ① 12", "Ⅷ", "", None, "_-!", "٣", "😀"]))
    assert all(map(L.has_letter, ["½a", "é", "日", "ª", "ñ1"]))
    docs = spark.createDataFrame([(i, "some words here", "xx") for i in range(40)] + [(90, "½ ²³ ① 12", "xx"), (91, "½ é", None)],
                                 "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in L.predict_langs(docs, L.fit_langs(docs)).collect()}
    assert (rows[90]["lang_pred"], rows[90]["score"]) == ("und", 0.0) and rows[91]["lang_pred"] == "xx"


def test_equally_likely_languages_go_by_name(spark):
    rng = np.random.default_rng(0)
    model = L.train(rng.integers(0, 255, (60, L.WINDOW), dtype=np.uint8), rng.integers(0, 2, 60), ["a", "b"])
    model.out[:] = 0
    model.out_bias[:] = 0
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert L.predict_langs(docs, model).first()["lang_pred"] == "a"
