import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import brown_lm as B
from tests.conftest import SF001


def test_gains_are_likelihood_differences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k = 9, 4
        pairs = rng.integers(0, 6, (n, n)).astype(float)
        unit_class = rng.integers(1, k, n)
        unit = int(rng.integers(0, n))

        def matrix(classes):
            m = np.zeros((k, k))
            np.add.at(m, (classes[:, None].repeat(n, 1), classes[None].repeat(n, 0)), pairs)
            return m

        rest = np.arange(n) != unit
        after = np.bincount(unit_class[rest], pairs[unit, rest], k)
        before = np.bincount(unit_class[rest], pairs[rest, unit], k)
        c = B.without_unit(matrix(unit_class), int(unit_class[unit]), after, before, pairs[unit, unit])
        gain = B.class_gains(c, after, before, pairs[unit, unit])
        values = []
        for t in range(1, k):
            moved = unit_class.copy()
            moved[unit] = t
            values.append(B.likelihood(matrix(moved)))
        assert np.allclose(gain[1:] - gain[1], np.array(values) - values[0])


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    return {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r for r in
                                                             B.language_model_scores(docs).collect()}


def test_counts_and_base_score(scored):
    texts, rows = scored
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(w for i, ws in words.items() if i not in held for w in [*ws, None])
    total, types = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = rows[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(ws) + 1 and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in [*ws, None])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in [*ws, None])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_better_than_word_frequencies_on_unseen_texts(scored):
    rows = [r for r in scored[1].values() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b c d e", "a a f", "", "g-h b c"] * 3
    model = B.fit_brown(spark.createDataFrame([(t,) for t in texts], "text string"), classes=5, rounds=3)
    n_own, end = len(model.unit_class) - 1 - B.ENDINGS, len(model.unit_class) - 1
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    by_class = np.bincount(model.unit_class, 10 ** model.emission, 5)
    assert np.allclose(by_class[by_class > 0], 1)
    # inside every ending, known words and one unseen word share the mass
    counts = Counter(w for t in texts for w in B.words_of(t))
    own = {w for w, u in zip(model.head, model.head_unit) if u < n_own}
    for e in {B.ending(w) for w in counts if w not in own}:
        mass = sum(n + 0.5 for w, n in counts.items() if w not in own and B.ending(w) == e) + 0.5
        assert math.log10(mass) == pytest.approx(model.inside[n_own + e])
    assert model.unit_class[end] == 0 and (model.unit_class[:end] > 0).all()


def test_score_by_hand(spark):
    texts = ["a b c a b", "b c d e", "a a f", "g-h b c"] * 4
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate([*texts, "a zzz b unseen zzz"])],
                               "doc_id long, held_out boolean, text string")
    model = B.fit_brown(df.where("doc_id < 16"), classes=4, rounds=2)
    n_own, end = len(model.unit_class) - 1 - B.ENDINGS, len(model.unit_class) - 1
    counts = Counter(w for t in texts for w in B.words_of(t))
    unit = {w: int(u) for w, u in zip(model.head, model.head_unit)}
    for r in B.score_brown(df, model).collect():
        words = B.words_of([*texts, "a zzz b unseen zzz"][r["doc_id"]])
        units = [unit.get(w, n_own + B.ending(w)) for w in words]
        total, last = 0.0, end
        for w, u in zip([*words, None], [*units, end]):
            total += model.transition[model.unit_class[last], model.unit_class[u]] + model.emission[u]
            if n_own <= u < end:
                total += math.log10(counts[w] + 0.5) - model.inside[u]
            last = u
        assert r["score"] == pytest.approx(total)


def placed_texts():
    rng = np.random.default_rng(3)
    kinds = {"a": [f"noun{i}x{i * 7}" for i in range(30)], "b": [f"verb{i}y{i * 5}" for i in range(30)]}
    texts = []
    for _ in range(400):
        out = []
        for _ in range(int(rng.integers(0, 6))):
            out += ["the", str(rng.choice(kinds["a"])), "will", str(rng.choice(kinds["b"]))]
        texts.append(" ".join(out))
    return texts


def test_words_are_placed_by_their_contexts(spark):
    df = spark.createDataFrame([(t,) for t in placed_texts()] + [(None,)], "text string").repartition(5)
    model = B.fit_brown(df, classes=6, rounds=3, frequent=16)
    place = {w: i for i, w in enumerate(model.head)}
    # only the two frequent words are in the exchange; all others are placed, nouns and verbs apart
    kinds = {kind: {int(model.unit_class[place[w]]) for w in place if w.startswith(kind)} for kind in (b"noun", b"verb")}
    assert len(place) == 62 and len(kinds[b"noun"]) == len(kinds[b"verb"]) == 1 and kinds[b"noun"] != kinds[b"verb"]
    by_ending = B.fit_brown(df, classes=6, rounds=3, frequent=16, least_count=10 ** 9)
    marked = df.selectExpr("1L as doc_id", "false as held_out", "text")
    total = [sum(r["score"] for r in B.score_brown(marked, m).collect()) for m in (model, by_ending)]
    assert total[0] > total[1]


def test_placing_against_brute_force(spark):
    texts = [*placed_texts()[:60], "solo", ""]
    words = sorted({w for t in texts for w in B.words_of(t)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rng = np.random.default_rng(5)
    first, last, k = 10, len(words) - 3, 5      # the last words aren't in the head
    head, head_unit = words[:last + 1], np.arange(last + 1)
    n_own = last + 1
    unit_class = np.concatenate([rng.integers(1, k, n_own + B.ENDINGS), [0]])
    matrix = rng.integers(0, 9, (k, k)).astype(float)
    numbers = B.word_numbers(df, head)
    got = B.place_words(numbers, first, last, head_unit, n_own, unit_class, matrix)
    unit = {w: i for i, w in enumerate(head)}
    low = (matrix.sum(axis=0) + 0.5) / (matrix.sum(axis=0) + 0.5).sum()
    move = B.smoothed(matrix)
    assert np.allclose(move.sum(axis=1), 1)
    gains, pairs = np.zeros((len(words), k)), np.zeros((k, k))
    for t in texts:
        run = [None, *B.words_of(t), None]
        classes = [0 if w is None else unit_class[unit.get(w, n_own + B.ending(w))] for w in run]
        for i in range(1, len(run)):
            pairs[classes[i - 1], classes[i]] += 1
            if run[i] is not None:
                gains[words.index(run[i])] += [math.log(move[c, classes[i + 1]]) + math.log(move[classes[i - 1], c])
                                               - math.log(low[c]) for c in range(k)]
    assert got.tolist() == [1 + int(np.argmax(gains[w, 1:])) for w in range(first, last)]
    assert np.array_equal(B.class_pairs(numbers, head_unit, n_own, unit_class, k), pairs)


def test_ties(spark):
    # words of equal contexts gain alike: the smallest class of the best ones counts, whatever the order of rows
    df = spark.createDataFrame([("x p y",), ("x q y",), ("x r y",)] * 3, "text string")
    head = [b"x", b"y", b"p", b"q", b"r"]
    unit_class = np.concatenate([[1, 2, 3, 3, 3], np.full(B.ENDINGS, 4), [0]])
    matrix = np.ones((5, 5))
    for rows in (df, df.repartition(7)):
        got = B.place_words(B.word_numbers(rows, head), 2, 5, np.arange(5), 5, unit_class, matrix)
        assert got.tolist() == [1, 1, 1]
    one, other = (B.fit_brown(rows, classes=4, rounds=2) for rows in (df, df.repartition(7)))
    assert one.head == other.head == [b"x", b"y", b"p", b"q", b"r"]
    assert np.array_equal(one.unit_class, other.unit_class)


def rare_word_texts():
    """Nouns and verbs of 3 to 12 occurrences, some side by side, and single words."""
    rng = np.random.default_rng(8)
    out = [*placed_texts()[:150], "", "once", "noun1x7 noun2x14 verb3y15 noun1x7", "the noun2x14 rareword noun2x14"]
    for i in range(40):
        out += [f"the kind{i}n will move{i}v kind{i}n move{(i * 3) % 40}v end"] * int(rng.integers(1, 4))
    return out


def test_words_outside_the_head_are_placed_as_well(spark):
    df = spark.createDataFrame([(i, i % 5 == 1, t) for i, t in enumerate([*rare_word_texts(), None, "the unseen noun1x7"])],
                               "doc_id long, held_out boolean, text string").repartition(6)
    train = df.where("not held_out")
    fit = {c: B.fit_brown(train, classes=6, rounds=3, frequent=32, carried=c) for c in (B.HEAD, 100, 1)}
    assert fit[100].any_rare and fit[1].any_rare and not fit[B.HEAD].any_rare
    assert len(fit[B.HEAD].head) > len(fit[100].head) > len(fit[1].head) > 0
    scores = {c: {r["doc_id"]: r for r in B.score_brown(df, m).collect()} for c, m in fit.items()}
    whole = fit[B.HEAD]
    n_own = len(whole.unit_class) - 1 - B.ENDINGS
    for c in (100, 1):
        # words have the classes they have when all words travel with the model
        found = {w: int(u) for w, u in zip(fit[c].head, fit[c].unit_class[fit[c].head_unit])}
        found |= {bytes(r["word"]): r["class"] for r in fit[c].counts.where("class is not null").collect()}
        for w, u, n in zip(whole.head, whole.head_unit, whole.head_count):
            assert (u < n_own) == (n >= B.LEAST_COUNT)
            if u < n_own:
                assert found[w] == whole.unit_class[u]
        assert np.allclose(fit[c].transition, whole.transition)
        for i, r in scores[B.HEAD].items():
            assert scores[c][i]["score"] == pytest.approx(r["score"], rel=1e-9)
            assert scores[c][i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
            assert scores[c][i]["n_known"] == r["n_known"]


def test_pairs_of_rare_words(spark):
    texts = ["a x y b", "x", "", "b a", "y a a x x", "z y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    numbers = B.word_numbers(df, [b"a", b"b"], True)
    pairs = B.rare_pairs(numbers, 2)
    got = Counter((r["a"], r["b"], *(w and bytes(w).decode() for w in (r["a_word"], r["b_word"]))) for r in pairs.collect())
    want, code = Counter(), {"a": 0, "b": 1, None: 2}
    for t in texts:
        run = [None, *t.split(), None]
        for p in zip(run, run[1:]):
            if set(p) & set("xyz"):
                want[(*(code.get(w, -1 - B.ending((w or "").encode())) for w in p),
                      *(w if w in set("xyz") else None for w in p))] += 1
    assert got == want
    placed = spark.createDataFrame([(bytearray(b"x"), 3), (bytearray(b"y"), 2)], "word binary, class int")
    classes = {"x": 3, "y": 2}
    rows = Counter((w and bytes(w).decode(), v and bytes(v).decode(), c, d) for w, v, c, d in
                   B.with_classes(pairs, placed).select("a_word", "b_word", "a_class", "b_class").collect())
    by_word = Counter()
    for (_, _, w, v), n in want.items():
        if {w, v} & set(classes):
            by_word[(w, v, classes.get(w), classes.get(v))] += n
    assert rows == by_word


def test_words_of_a_slice(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [*map(chr, range(0x30)), "\x7f", "\x80", "\x85", "\xa0", "　", "A", "b", "Z", "É", "İ", "\U0001f600"]
    texts = [None, "", "  ", " a "] + ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 60, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["left out", *texts])[1:]], names=["text"])

    class Places(B._Places):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    want = [B.words_of(t) for t in texts]
    places = Places(pa.array([b"a", b"b"], pa.binary()))
    numbers, offsets, codes, distinct = B._numbered(batch.column(0), places)
    found = [distinct[c].as_py() for c in codes]
    assert [found[a:b] for a, b in zip(offsets, offsets[1:])] == want
    assert numbers.tolist() == [{b"a": 0, b"b": 1}.get(w, -1 - B.ending(w)) for w in found]
    # a word is looked up once, however often it occurs
    assert places.asked == len(set(found)) < len(found)
    monkeypatch.setattr(B, "SLICE", 100)
    slices = list(B._slices(iter([batch, batch.slice(0, 0)])))
    assert len(slices) > 20 and pa.Table.from_batches(slices).column(0).to_pylist() == texts


def test_contexts_are_handed_on_in_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCKS", 7)
    k, rng = 3, np.random.default_rng(4)
    numbers = [rng.integers(0, 50 * 2 * k, 400) for _ in range(5)]
    rows = [r for batch in B._in_blocks(B._sums(iter(numbers)), k) for r in batch.to_pylist()]
    # one row a block, not one a word and context
    assert len(rows) == 7
    got = {(slot // (2 * k) * 7 + r["block"]) * 2 * k + slot % (2 * k): n
           for r in rows for slot, n in zip(r["slots"], r["n"], strict=True)}
    assert got == Counter(np.concatenate(numbers).tolist())
    assert sum(batch.num_rows for batch in B._in_blocks(B._sums(iter([])), k)) == 0


def test_sums_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(B, "FLUSH", 10)
    rng = np.random.default_rng(6)
    numbers = [rng.integers(0, 300, 30) for _ in range(40)]
    got, parts = Counter(), 0
    for keys, n in B._sums(iter(numbers)):
        assert (np.diff(keys) > 0).all()
        got.update(dict(zip(keys.tolist(), n.tolist())))
        parts += 1
    assert got == Counter(np.concatenate(numbers).tolist()) and parts > 2
