import math
from collections import Counter

import public_tokenizers
import pytest

from corpusloom.llm import sp_sampling as S
from tests.conftest import SF001

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "▁ ▁▁ a▁b", "  two  spaces   end  ", "x\n\ty\r\n", "日本語 テキスト ². __.", "a" * 500, "<0x0A> <s> </s>",
       "﷐ 🎉🎉", "é" * 150 + "▁", "lose  ", "\u0000￾"]


@pytest.fixture(scope="module")
def lattices():
    return S.Lattices(S.load_pieces(PATH))


def test_round_trip(lattices):
    ids = S.encode_texts(list(enumerate(ODD)), lattices)
    assert [S.decode_ids(i, lattices.pieces.raw) for i in ids] == ODD


def test_documents_round_trip_and_decode(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    encoded = S.encode_sampled(docs, PATH).cache()
    assert encoded.where("not lossless").count() == 0
    texts = {r["doc_id"]: r["text"] for r in S.decode_pieces(encoded, PATH).collect()}
    assert texts == {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    # another partitioning, the same draws; another seed, others
    again = S.encode_sampled(docs.repartition(7), PATH)
    assert {(r["doc_id"], tuple(r["ids"])) for r in again.collect()} == {
        (r["doc_id"], tuple(r["ids"])) for r in encoded.collect()}
    other = {r["doc_id"]: r["ids"] for r in S.encode_sampled(docs, PATH, seed=1).collect()}
    assert any(other[r["doc_id"]] != r["ids"] for r in encoded.collect())
    encoded.unpersist()


def segmentations(shown, ids):
    if not shown:
        yield ()
    for k in range(1, len(shown) + 1):
        if shown[:k] in ids:
            yield from ((ids[shown[:k]], *rest) for rest in segmentations(shown[k:], ids))


@pytest.mark.parametrize("word", ["thing", "the", "aaaa"])
def test_draws_follow_the_lattice_weights(lattices, word):
    pieces, n = lattices.pieces, 20_000
    weight = {g: math.prod(pieces.weights[i] for i in g) for g in segmentations(S.SPACE + word, pieces.ids)}
    total = sum(weight.values())
    seen = Counter(tuple(i.tolist()) for i in S.encode_texts([(i, word) for i in range(n)], lattices))
    assert set(seen) <= set(weight)
    for g, w in weight.items():
        p = w / total
        assert abs(seen[g] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_blocks_and_shared_prefixes_change_nothing(lattices, monkeypatch):
    text = "Some words, repeated  and   spaced; " * 50 + "z" * 100
    whole = S.encode_texts([(9, text)], lattices)[0].tolist()
    fresh = S.Lattices(lattices.pieces)
    monkeypatch.setattr(S, "SHARED_CHARS", 3)
    assert S.encode_texts([(9, text)], fresh)[0].tolist() == whole
    monkeypatch.setattr(S, "BLOCK_CHARS", 20)
    assert S.encode_texts([(8, "x y"), (9, text)], S.Lattices(lattices.pieces))[1].tolist() == whole
