import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import token_counts as T
from tests.conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def count():
    return T._counter(PATH, T.load_vocabulary(PATH).whole)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_strings_are_single_tokens(library):
    whole = sorted(T.load_vocabulary(PATH).whole)
    assert len(whole) > 40_000
    some = whole[::97]
    # a whole string is one token when it is a pre-token; most are
    assert sum(n == 1 for n in library(some)) > 0.99 * len(some)


def test_every_character_class(count, library):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}  {chr(c)}\n" for c in range(0, 0x3000)]
    texts += [f"a{chr(c)} {chr(c)}" for c in range(0x3000, 0x20000, 89) if not 0xD800 <= c < 0xE000]
    assert [count(t) for t in texts] == library(texts)


def test_special_strings_and_long_words(count, library):
    texts = ["", "<|endoftext|>", " <|endoftext|>  <|endoftext|>x\n\n", "a" * 5000, "!" * 3000 + " " * 99, "é" * 777,
             "ab" * 40, "it's we'll I'd", "\t\t x  \n"]
    assert [count(t) for t in texts] == library(texts)


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r["doc_id"]: r for r in T.token_counts(docs, PATH, limit=500).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        n = library([r["text"]])[0]
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len(r["text"].encode()), n, n > 500)
