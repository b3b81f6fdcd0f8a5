"""Equal-average search and codebook training against plain brute force."""

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import vector_codes as VC

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract, one Python integer at a time."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    d = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * float(np.float32(x))) for x in v[p * d:(p + 1) * d]] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: kept[i][0])[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry
                        for e, entry in enumerate(books[p])]
    coded = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(x[0] for x in c) for c in coded]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((kept[i][0], "".join(f"{x[1]:02x}" for x in coded[i]), errors[i],
                   sum(e for e, k in zip(errors, kept) if k[2] == kept[i][2]), digest) for i in range(len(kept)))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_equals_all_distances_with_ties():
    rng = np.random.default_rng(5)
    for d, spread in ((1, 3), (2, 2), (8, 4), (8, 5000), (5, 1 << 20)):
        book = rng.integers(-spread, spread + 1, (16, d))
        book[7] = book[3]                               # equal entries: the lower number counts
        vectors = rng.integers(-spread, spread + 1, (500, d))
        number, best = VC.nearest(vectors, book)
        every = ((vectors[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_entries_whose_bound_equals_the_best_are_looked_at():
    # sums 0 and 4 around a part of sum 2: both gaps bound exactly the distance of both entries
    book = np.array([[2, 2], [0, 0]])
    number, best = VC.nearest(np.array([[1, 1]]), book)
    assert (number[0], best[0]) == (0, 2)


def test_limits_do_not_overflow():
    for d in (1, 8, 96, 512):
        most = VC.limit(d)
        book = np.full((2, d), most, dtype=np.int64)
        book[1] = -most
        number, best = VC.nearest(-book, book)
        assert number.tolist() == [1, 0] and best.tolist() == [0, 0]
        assert int(VC.nearest(book[:1], book[1:])[1][0]) == d * (2 * most) ** 2


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=16).astype(np.float32)], int(i % 3) or None) for i in rng.permutation(120)]
    rows += [(500 + i, rows[0][1], 7) for i in range(40)]           # a hot vector
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1),
             (903, [float("-inf")] + [0.0] * 15, 2), (904, [-0.00001] * 16, 2)]
    assert rows_of(VC.compressed_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_fewer_vectors_than_entries_and_unused_entries(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.5] * 8, None), (2, [-1.0] * 8, None)]
    got = rows_of(VC.compressed_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and [r[1] for r in got] == ["00" * 8, "01" * 8, "00" * 8]


def test_messy_rows(spark):
    rows = [(None, [1.0] * 9, 1), (4, [2.0] * 9, 1), (4, [2.0] * 9, 1), (4, [3.0] * 9, None), (5, [2.0] * 3, 1),
            (6, [], 1), (7, [1e30] * 9, 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "2 AS part", "3 AS _vector", "4 AS of")
    got = VC.compressed_vectors(df).collect()
    # the dimension is that of vec_id 4; 9 components are filled up to 16; 1e30 is held at the limit
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 4, 4, 4, 7]
    assert all(len(r["code"]) == 16 for r in got) and len({r["codebooks_sha256"] for r in got}) == 1
    first, second = [r for r in got if r["vec_id"] == 4 and r["error"] == min(x["error"] for x in got if x["vec_id"] == 4)][:2]
    assert first == second


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(None, [1.0] * 8, 1)]])
def test_nothing_to_encode(spark, rows):
    df = VC.compressed_vectors(spark.createDataFrame(rows, SCHEMA))
    assert df.collect() == [] and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoding_gives_the_entries(spark):
    rows = [(i, [i / 8 + j for j in range(10)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = VC.fit_codebooks(df)
    coded = VC.encode_vectors(df, model)
    for r in VC.decode_vectors(coded, model).collect():
        v = np.floor(np.array(rows[r["vec_id"]][1]) * 4096)
        assert len(r["decoded"]) == 10 and ((np.array(r["decoded"]) * 4096 - v) ** 2).sum() == pytest.approx(r["error"])
