"""BPE training / encoding and pre-tokens against direct Python implementations."""

import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import vocab as V
from corpusloom.plans import vocab_q as Q


def _py_bpe(freqs, n):
    syms = {w: list(w) for w in freqs if len(w) > 1}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, s in syms.items():
            for a, b in zip(s, s[1:]):
                pairs[(a, b)] += freqs[w]
        if not pairs:
            break
        (a, b), c = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        merges.append((a, b, c))
        for w, s in syms.items():
            out, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            syms[w] = out
        syms = {w: s for w, s in syms.items() if len(s) > 1}
    return merges


def test_bpe_matches_python(spark):
    text = ("low lower lowest newer newest wider widest low low new new ab ab aaa aaaa "
            "müde müder straße straßen") * 3
    freqs = Counter(w for w in text.split())
    words = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    got = V.bpe_train(words, 15, byte_level=False)
    assert got == _py_bpe(dict(freqs), 15)
    ranks = {(a, b): i for i, (a, b, _) in enumerate(got)}
    assert V.merged(list("lowest"), ranks)[0] == "low" and "".join(V.merged(list("straßen"), ranks)) == "straßen"


@pytest.mark.parametrize("segments, pairs", [(1 << 17, 1 << 12), (40, 1 << 12), (12, 9), (400, 30)])
def test_many_merges_a_round_equal_one_by_one(spark, monkeypatch, segments, pairs):
    """All merges down to the last pair, whatever number of pairs a round links; ties, runs of one letter, repeated tokens."""
    rng = random.Random(segments)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(14)] + ["aaaa", "aaa", "bb", "abab"]
    freqs = Counter("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(160))
    rounds, seen = [], V.follow_merges
    monkeypatch.setattr(V, "SEGMENTS", segments)
    monkeypatch.setattr(V, "PAIRS_SEEN", pairs)
    monkeypatch.setattr(V, "follow_merges", lambda *a: rounds.append(seen(*a)) or rounds[-1])
    words = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    n = 500 if segments > 1000 else 40
    got = V.bpe_train(words, n, byte_level=False)
    assert got == _py_bpe(dict(freqs), n)
    if segments > 1000:
        assert len(got) > 100 and len(rounds) < len(got) / 3


def test_letters_outside_the_alphabet_and_least_count(spark):
    freqs = {"abxab": 5, "ab": 3, "xx": 9, "aab": 1}
    words = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    assert V.bpe_train(words, 9, byte_level=False, letters=["a", "b"]) == [("a", "b", 14), ("a", "ab", 1)]
    assert V.bpe_train(words, 9, byte_level=False, letters=["a", "b"], min_frequency=2) == [("a", "b", 14)]
    assert V.bpe_train(words, 0) == [] and V.bpe_train(words.where("false"), 5) == []


def test_merging_a_known_token_ends_a_round():
    # (a, bc) spells the known token abc, whose other pairs may stand outside the segments
    got = V.follow_merges([(["a", "bc", "d"], 5), (["x", "y"], 4)], 9, 0, 1, {"a", "bc", "d", "x", "y", "abc"})
    assert got == [("a", "bc", 5)]


def test_tokenizer_round_trip_and_ids(spark):
    docs = spark.createDataFrame([(1, "Café <GET> /index.html it's 42\n\tnaïve straße 日本"), (2, None), (3, "")] + [
        (10 + i, "the theme then there the other") for i in range(5)], "doc_id long, text string")
    t = V.train_tokenizer(docs, "text", vocab_size=200)
    vocabulary = t.vocabulary()
    assert len(vocabulary) <= 200 and vocabulary[:2] == ["<pad>", "<unk>"] and len(t.special) == 111
    rows = V.encode(docs, "text", t).select("doc_id", "text", "ids", V.decode(F.col("ids"), t).alias("back")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] == by[1]["back"] == "Cafe <GET> /index.html it's 42\n\tnaive straße 日本"
    assert vocabulary.index("<GET>") in by[1]["ids"] and "the" in vocabulary
    assert list(by[2]["ids"]) == [] and list(by[3]["ids"]) == [] and by[3]["back"] == ""
    # a symbol outside a limited alphabet is unknown
    small = V.train_tokenizer(docs, "text", vocab_size=150, alphabet_limit=10)
    assert 1 in {i for r in V.encode(docs, "text", small).collect() for i in r["ids"]}


def test_pretokens_and_accents(spark):
    s = "Héllo, wörld <s>x</s> a.b-c:d/e!!  fin"
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(V.pretokens(F.col("t")).alias("p"), V.strip_accents("t").alias("a")).first()
    want = re.findall(r"<s>|</s>|\s+|[^\w\s<>/.\-:]+|[\w<>/.\-:]+", s)
    assert list(r["p"]) == want
    assert r["a"] == "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def test_python_gets_small_batches(spark):
    """Texts go to Python in batches of bounded bytes, not of 64 MB; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        df = spark.createDataFrame([("\u00e9" * 200_000,)] * 40, "t string").coalesce(1)
        V.normalized(df, "t")
        sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        got = [r["n"] for r in sizes.collect()]
        assert sum(got) > 16_000_000 and max(got) < 2 * session.BATCH_BYTES
        for now, then in (("4096", "4096"), ("4096b", "4096"), ("64m", str(session.BATCH_BYTES))):
            spark.conf.set(key, now)
            session.small_batches(df)
            assert spark.conf.get(key).removesuffix("b") == then
    finally:
        spark.conf.set(key, was)


def test_one_pass_cut_gives_the_same_pieces(spark):
    """Letters, digits, other numbers, joiners, marks, scripts and special tokens, at the start and inside a run."""
    texts = ["it's 2nd_x-y/z: a.b<c>d  \t\n e", "½²x² Ⅻ٣a__٣ x\u200dy!?½!", "naïve Ωμέγα 日本語123 \u00a0x\x1cy", "a<pad> <pad>b<s></s>!<s>x",
             "", " ", "!!'s 't", None, "e\u0301 \u0903क\u093f १२", "\U0001d400\U0001f600\U0001d7d8a"]
    rng = random.Random(5)
    signs = "aZé_0٣²½Ⅻ<>/.-:!'\u200d\u0301\u00a0 \n日क\u093f\U0001f600"
    texts += ["".join(rng.choice(signs) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", V.byte_level_pieces(V.pretokens(F.col("text"))).alias("two"), V.cut_pieces(F.col("text")).alias("one")).collect()
    assert all(r["one"] == r["two"] for r in rows), [r for r in rows if r["one"] != r["two"]][:3]
    assert sum(r["one"] is not None and len(r["one"]) > 1 for r in rows) > 300


def test_encode_maps_distinct_pieces_of_a_batch(spark):
    """Repeated, special, unknown and missing pieces in their rows' order, over several batches; Arrow arrays, not a Python list per row."""
    tok = V.Tokenizer(["<unk>", "<pad>"], ["a", "b", "Ġ"], [("a", "b", 9), ("ab", "a", 5)])
    number = {t: i for i, t in enumerate(tok.vocabulary())}
    texts = ["aba aba <pad> xab", None, "", "ab" * 5, "ba ab"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    e = V.encode(docs, "t", tok)
    assert "to_ids" in (plan := e._jdf.queryExecution().executedPlan().toString()) and ", 204" not in plan
    ranks = {(a, b): i for i, (a, b, _) in enumerate(tok.merges)}
    expected = [[i for piece in re.findall(r"<pad>|\S+|\s+", t or "") for i in ([1] if piece == "<pad>" else [
        number.get(x, 0) for x in V.merged(V.symbols_of(piece, True), ranks)])] for t in texts]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [r["ids"] for r in e.orderBy("id").collect()] == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_for_the_driver_are_picked_by_a_task(spark, monkeypatch):
    """No more pairs than a round links, and one, are read by the driver, however many parts the counts have."""
    written, seen = [], V.materialized
    monkeypatch.setattr(V, "materialized", lambda df, name: written.append((name, seen(df, name))) or written[-1][1])
    freqs = {"".join(w): 3 + i for i, w in enumerate([x + y for x in ("ab", "cd", "ef", "gh", "ij") for y in "klmnopqrst"])}
    words = spark.createDataFrame(list(freqs.items()), "word string, freq long").repartition(6)
    monkeypatch.setattr(V, "PAIRS_SEEN", 5)
    assert V.bpe_train(words, 4, byte_level=False) == _py_bpe(freqs, 4)
    sizes = [df.count() for name, df in written if name == "bpe-pairs"]
    assert sizes and max(sizes) <= 6


def test_merges_behind_a_repeated_symbol(spark):
    """A symbol that is made a second time meets the earlier merges again, place by place, as `merged` does."""
    words = ["pqrpqr", "xqrpq", "pqrpqrpqr", "pqpq"]
    ranks = {("q", "r"): 0, ("p", "qr"): 1, ("pqr", "p"): 2, ("p", "q"): 3, ("pq", "r"): 4}
    state = spark.createDataFrame([("".join(w), 1) for w in words], "sym string, freq long")
    sign = {"qr": "A", "pqr": "B", "pqrp": "C", "pq": "D"}
    merges = [(sign.get(a, a), sign.get(b, b), sign[a + b]) for a, b in ranks]
    got = {r["sym"] for r in V.merged_table(state, merges, True, "\U000f0000").collect()}
    expected = [[sign.get(x, x) for x in V.merged(list(w), ranks)] for w in words]
    assert got == {"".join(w) for w in expected if len(w) > 1}


def test_cut_padded_ids_and_mask(spark):
    """Below, at and above the length, none, and both lengths of the reference; only the mask tells a padding id from a real one."""
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 255, 256, 257, 511, 512, 513, 700)], "n int, ids array<int>")
    for size in (512, 256):
        ids, mask = V.pad_truncate(F.col("ids"), size)
        for r in df.select("n", ids.alias("x"), mask.alias("m")).collect():
            held = min(r["n"], size)
            assert r["x"] == [*range(held)] + [0] * (size - held) and r["m"] == [1] * held + [0] * (size - held)


def test_pad_mask_returns_the_sequences_and_their_labels(spark, tmpdir_path):
    """Ids in their texts' order, mask and labels of every document: short, of 512 tokens, longer, empty, missing and twice."""
    texts = ["the theme then", "a " * 256, "a " * 256 + "a", "b c " * 400, "<pad> the <pad> \u00e9t\u00e9", "", None, "then the theme", "the theme then"]
    docs = [(i if i < 8 else 0, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmpdir_path}/documents.parquet")
    d = Q.pad_mask(spark, tmpdir_path)
    assert d.columns == ["doc_id", "input_ids", "attention_mask", "labels", "attended", "padding", "id_checksum"]
    tok = Q.tokenizer(spark, tmpdir_path)
    ranks, number = {(a, b): i for i, (a, b, _) in enumerate(tok.merges)}, {t: i for i, t in enumerate(tok.vocabulary())}
    expected = []
    for key, text, _ in docs:
        ids = [i for piece in re.findall(r"<pad>|\w+|\s+", V._strip(text) or "") for i in ([0] if piece == "<pad>" else [
            number[x] for x in V.merged(V.symbols_of(piece, True), ranks)])]
        cut = ids[:512]
        x = cut + [0] * (512 - len(cut))
        expected.append((key, x, [1] * len(cut) + [0] * (512 - len(cut)), x, len(cut), 512 - len(cut), sum(cut)))
    assert sorted(tuple(r) for r in d.collect()) == sorted(expected)
    assert {r[4] for r in expected} >= {0, 512} and expected[0][1] != expected[7][1] and expected[0][6] == expected[7][6]
