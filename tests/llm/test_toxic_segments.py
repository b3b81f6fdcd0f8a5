import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import toxic_segments as T


def every_maximal(scores):
    """By definition: the best subsequence, then those of what lies before and after it (shortest first)."""
    best = (0.0, 0, 0)
    for i, j in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[i:j])
        if total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and best[0] > 0 and j - i < best[2] - best[1]:
            best = (total, i, j)
    if best[0] <= 0:
        return []
    total, i, j = best
    return (every_maximal(scores[:i]) + [(i, j - 1, total)]
            + [(a + j, b + j, s) for a, b, s in every_maximal(scores[j:])])


def test_all_maximal_segments():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.1, -1.7, -0.9, 0.83, 1.37, 2.71]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(0, 14))]
        found = T.maximal_segments([(i, i, s) for i, s in enumerate(scores)])
        expected = every_maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_rate_solves_its_equation():
    values, shares = np.array([-0.2, 3.0, 5.0]), np.array([0.999, 0.0006, 0.0004])
    rate = T.solve_rate(values, shares)
    assert (shares * np.exp(rate * values)).sum() == pytest.approx(1.0)


def test_repeats_count_less():
    model = T.ToxicModel({"bad": 4.0})
    assert [s for _, s in model.token_scores(["bad", "x", "bad", "bad"])] == [4.0, 2.0, 1.0]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(20, 80))
        toxic = int(i % 6 == 0)
        if toxic:
            at = rng.randrange(len(words))
            # one lexicon word as it is, one stem with ever new endings
            words[at:at] = ["vilest", "scornq" + "".join(rng.choices("xyz", k=3))]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, marks, T.fit_toxic(docs, marks)


def test_held_out_accuracy(fitted):
    docs, marks, model = fitted
    rows = T.score_toxic(docs, model).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.98 * len(rows)


def test_passages_hold_the_planted_words(fitted):
    docs, marks, model = fitted
    found = T.toxic_passages(docs.where("doc_id < 120"), model).collect()
    assert {r["doc_id"] for r in found} == set(range(0, 120, 6))
    assert all("vilest" in r["passage"] or "scornq" in r["passage"] for r in found)
    assert all(r["e_value"] <= T.SIGNIFICANT for r in found)


class _Counted(float):
    """A total that counts how often it is compared."""
    n = 0

    def __add__(self, other):
        return _Counted(float(self) + float(other))

    __radd__ = __add__

    def __ge__(self, other):
        _Counted.n += 1
        return float(self) >= float(other)


@pytest.mark.parametrize("shape", ["falling", "rising", "mixed"])
def test_the_search_takes_steps_in_proportion_to_the_runs(shape):
    steps = []
    for n in (1000, 2000, 4000):
        rng = random.Random(n)
        step = {"falling": (1.0, -2.0), "rising": (1.0, -0.5)}.get(shape)
        items = [(i, i, _Counted(step[i % 2] if step else rng.choice([1.0, 2.5]) if i % 2 == 0 else -rng.uniform(0.5, 3)))
                 for i in range(n)]
        _Counted.n = 0
        found = T.maximal_segments(items)
        steps.append(_Counted.n)
        assert len(found) == {"falling": n // 2, "rising": 1}.get(shape, len(found))
    assert steps[0] < 5 * 1000 and steps[1] < 2.3 * steps[0] and steps[2] < 2.3 * steps[1]


def test_equal_totals_do_not_join():
    # ties: a segment that only regains what it lost stays apart
    assert T.maximal_segments([(0, 0, 2.0), (1, 1, -2.0), (2, 2, 2.0)]) == [(0, 0, 2.0), (2, 2, 2.0)]
    assert T.maximal_segments([(0, 0, 1.0), (1, 1, -0.5), (2, 2, 0.5)]) == [(0, 0, 1.0), (2, 2, 0.5)]
