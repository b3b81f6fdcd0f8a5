import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import graph, simhash_dedup as S
from tests.conftest import SF001


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_roots(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", " ", "one", "one two three", "A b c D", "a b c d e f g", "É É é x y \x0b z",
                                  "no\xa0break space is a letter here"])
def test_fingerprint(text):
    assert S.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "c", "def", "G"], k=3000))
    monkeypatch.setattr(S, "PIECE", 50)
    assert S.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def test_bound_never_exceeds_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    bound = np.bitwise_count(S.embed_array(a) ^ S.embed_array(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()
    counts = [[int(x) >> 2 * s & 1 + (int(x) >> 2 * s + 1 & 1) for s in range(32)] for x in a[:5]]
    assert all(len(c) == 32 for c in counts)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("chunk", [1 << 16, 8])
def test_links_against_all_pairs(spark, chunk):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres) | {0, (1 << 64) - 1}
    for c in centres[:4]:
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in S.near_links(df, 4, chunk_size=chunk).collect()]
    expected = naive_roots(fps, 4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == expected


def test_large_cells_are_scanned():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(600)})
    a, b = S.link_cells(np.zeros(len(fps), dtype=np.int64), np.array(fps, dtype=np.uint64), 4)
    expected = naive_roots(fps, 4)
    assert len(a) < len(fps)            # a forest, not all pairs
    root = {f: f for f in fps}
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    assert len({f for f in fps if root[f] == f}) == len(set(expected.values()))


def test_components_of_a_path_a_star_and_a_cycle(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200),
                                                                                     (300, 300)]
    rows = graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    got = {r["vertex"]: r["root"] for r in rows}
    assert len(rows) == len(got)
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: naive_fingerprint(r["text"]) for r in docs.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == fps
    roots = naive_roots(sorted(set(fps.values())), 4)
    lowest = {}
    for i in sorted(fps):
        lowest.setdefault(roots[fps[i]], i)
    assert {i: r["component_id"] for i, r in rows.items()} == {i: lowest[roots[f]] for i, f in fps.items()}
    kept = sorted(r["doc_id"] for r in S.one_of_each(docs).collect())
    assert kept == sorted(lowest.values())


def test_blocks_follow_the_number_of_fingerprints():
    few, many, more = (S.blocks_for(n, 4) for n in (1000, 10 ** 6, 10 ** 9))
    assert 5 <= few <= many < more <= 16


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_any_number_of_blocks_gives_the_same_components(spark, blocks):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {f for b in base for f in [b] + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for _ in range(4)]}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    got = {r["fp"]: r["root"] for r in S.fingerprint_roots(df, 4, blocks).collect()}
    roots = naive_roots(sorted(fps), 4)
    groups = {}
    for f, r in roots.items():
        groups.setdefault(r, set()).add(signed[f])
    assert {frozenset(g) for g in groups.values()} == {frozenset(v for v in got if got[v] == r) for r in set(got.values())}


def test_columns_named_like_its_own_come_back_unchanged(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y")], "doc_id long, text string, _simhash_row0 int, _simhash_fp0 string")
    assert [tuple(r) for r in S.one_of_each(df).collect()] == [(1, "a b c d e", 7, "x")]
