import numpy as np

from corpusloom.llm import quality_gam as Q


def test_features():
    zero = Q.text_features(None)
    assert (zero == Q.text_features("")).all() and not zero.any()
    f = dict(zip(Q.FEATURES, Q.text_features("AB cd cd\n1,")))
    assert f["upper_share"] == 2 / 11 and f["digit_share"] == 1 / 11 and f["mark_share"] == 1 / 11
    assert f["distinct_words"] == 3 / 4 and f["repeat_share"] == 1 / 3 and f["distinct_lines"] == 1.0


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)      # needs the pair
    model = Q.fit_gam(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    bins = model.bins(x[:5])
    for row, z in zip(bins, model.logits(x[:5])):
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, row))
        total += sum(t[row[i], row[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(z, total)


def test_shallow_trees():
    g, h = np.array([5.0, 5, -5, -5, 0, 0, 9, 9]), np.full(8, 3.0)
    assert len(set(Q._tree_table(g, h))) <= Q.LEAVES
    gain, table = Q._quadrants(np.outer([1, 1, -1, -1], [1, 1, 1, -1]) * 4.0, np.full((4, 4), 2.0))
    assert gain > 0 and len(set(table.ravel().round(9))) <= 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.score_quality(docs, Q.fit_quality(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_one_label():
    assert Q.fit_gam(np.ones((4, 2)), np.ones(4)).score(np.zeros((1, 2)))[0] > 0.8
    assert Q.fit_gam(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
