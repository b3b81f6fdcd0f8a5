import hashlib
import random
import re

import pytest

from corpusloom.llm import decontam as D
from tests.conftest import SF001


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def naive(text, items, window=13):
    w = words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(window, len(v))
        phrases = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if v else ():
            if tuple(w[i:i + n]) in phrases:
                hit |= set(range(i, i + n))
                if item_id is not None:
                    ids.add(str(item_id))
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "A", "é", "ÉÉ", "x1", "no", "it", "zebra", "lion"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 5, 12, 13, 14, 30, 40, 13, 60])]
    items += [(10, "the the the the the the the the the the the the the the"), (2, "it zebra"), (11, "")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(len(v) - 5, 0))
            parts += [", ".join(v[a:a + rng.randint(5, 40)]).upper(), " ".join(rng.choices(vocabulary, k=5))]
        docs.append((i, "\n".join(parts)))
    docs += [(80, "the " * 200), (81, None), (82, ".")]
    return (docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("window", [13, 4])
def test_against_every_window(tables, window):
    docs, items, d, b = tables
    got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(d, b, window).collect()}
    assert got == {i: naive(t, items, window) for i, t in docs}


def test_shuffled_where_terms_are_many(tables, monkeypatch):
    docs, items, d, b = tables
    monkeypatch.setattr(D, "BROADCAST_TERMS", 0)
    got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(d, b).collect()}
    assert got == {i: naive(t, items) for i, t in docs}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(docs, bench).collect()}
    assert got == {r["doc_id"]: naive(r["text"], items) for r in docs.collect()}
    assert any(v[4] for v in got.values())


def naive_near(text, item, window=13):
    """(start, first, n_near) of the item's tiles, from every stretch of the text."""
    w, v, found = words(text), words(item), set()
    last = max(len(v) - window, 0)
    for start in {*range(0, last + 1, window), last} if v else ():
        terms = set(v[start:start + window])
        counts = [(len(set(w[a:a + 2 * window]) & terms), -a) for a in range(len(w)) if w[a] in terms]
        n, back = max(counts, default=(0, 0))
        if n and n >= len(terms) - len(terms) // 5:
            found.add((start, -back, n))
    return found


def proximity(docs, items):
    listed = D.item_terms(items)
    index = D.build_index(docs, listed)
    names = {r["row"]: r["doc_id"] for r in index.where("pos = -1").collect()}
    return {(names[r["row"]], r["item_id"], r["start"], r["first"], r["n_near"])
            for r in D.proximity_matches(index, listed).collect()}


@pytest.mark.parametrize("terms", [1 << 18, 0])
def test_proximity(tables, spark, monkeypatch, terms):
    monkeypatch.setattr(D, "BROADCAST_TERMS", terms)
    rng = random.Random(5)
    vocabulary = [f"w{int(40 * rng.random() ** 2)}" for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 5, 9, 13, 14, 26, 40])]
    items += [(8, items[7][1]), (9, "unknown words only"), (10, ""), (11, None)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(60)] + [(60, None), (61, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = {(i, str(j), *m) for i, t in docs for j, v in items for m in naive_near(t, v)}
    assert len(expected) > 100 and proximity(d, b) == expected


def test_proximity_without_the_rarest_terms(spark):
    """An item's words in another order, with the one or two rarest replaced; three are too many."""
    item = [f"t{i}" for i in range(13)]
    common = [(100 + i, " ".join(item[2:])) for i in range(3)]      # t0 and t1 become the rarest
    texts = {1: item[::-1], 2: ["x"] + item[:0:-1], 3: ["x", "y"] + item[:1:-1], 4: ["x"] * 3 + item[3:],
             5: item[:6] + ["x"] * 13 + item[6:], 6: item[:6] + ["x"] * 14 + item[6:]}
    docs = [(i, " ".join(["filler"] * 20 + t + ["filler"] * 20)) for i, t in texts.items()] + common + [(7, "t0 t1")]
    got = proximity(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert got == {(i, "0", *m) for i, t in docs for m in naive_near(t, " ".join(item))}
    assert {g[0] for g in got} >= {1, 2, 3, 5, 6} and 4 not in {g[0] for g in got}
    assert {g[0]: g[4] for g in got}[5] == 13 and {g[0]: g[4] for g in got}[6] == 12


def test_query_counts_items_with_proximity_matches(tables):
    docs, items, d, b = tables
    some = [(i, t) for i, t in items if i in (3, 4, 7)]
    got = {r["doc_id"]: r["n_near_items"] for r in D.contamination(d, b.where("item_id in (3, 4, 7)"), proximity=True).collect()}
    assert got == {i: sum(bool(naive_near(t, v)) for _, v in some) for i, t in docs}


def test_plan_has_no_python(tables):
    _, _, d, b = tables
    plan = D.contamination(d, b, proximity=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
