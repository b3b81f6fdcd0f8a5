"""The manifest against the contract spelled out in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return H(*(field(v) for v in (r[0], r[3], r[2], r[4], r[1])))


def climb(hashes):
    """Root, and per node its siblings level by level with its place in each run."""
    paths = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for i, k in enumerate(at):
            run = hashes[k // 16 * 16:k // 16 * 16 + 16]
            paths[i].append((run[:k % 16], run[k % 16 + 1:]))
            at[i] = k // 16
        hashes = [H(*hashes[k:k + 16]) for k in range(0, len(hashes), 16)]
    return hashes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in by[s]])
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, above):
        for r, under in zip(by[s], trees[s][1]):
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                shown = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            h = leaf(shown)
            for left, right in under + over:
                h = H(*left, h, *right)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(x for p in under + over for side in p for x in side)), h, h == root))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS rank", "2 AS n", "3 AS tree", "4 AS part", "5 AS tie")
    got = sorted((tuple(r) for r in M.verified_documents(df.repartition(parts)).collect()), key=str)
    assert got == brute(rows)
    return got


def rows_of(sizes, first=0):
    out, i = [], first
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i * 7 % 1009, f"Text {i} Ünï" if i % 11 else None, "en" if i % 3 else None, s, i if i % 5 else None))
            i += 1
    return out


def test_runs_of_every_shape(spark):
    got = check(spark, rows_of({"hot": 275, "b": 17, "c": 16, "a": 1, "é": 2, None: 33, "Z": 256}))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 2}, {"one": 17}, {f"s{i:02d}": 1 for i in range(18)}, {None: 1, "": 1}])
def test_small_datasets(spark, sizes):
    check(spark, rows_of(sizes, 3))


def test_messy_rows(spark):
    rows = [(None, "No id", "en", "s", 1), (None, None, None, None, None), (1, "A", "en", "s", 1), (1, "A", "en", "s", 1),
            (1, "B", "en", "s", 1), (2, "", "en", "", 0), (2, None, "en", "", 0), (5, "L" * 300_000, "en", "s", 300_000)]
    check(spark, rows + [(7, "Same", "en", "t", 4)] * 40)


def test_empty_table(spark):
    df = M.verified_documents(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_wanted_leaves_alone(spark):
    rows = rows_of({"a": 300, "b": 5, "c": 1, **{f"x{i}": 1 for i in range(20)}})
    manifest = M.build_manifest(spark.createDataFrame(rows, SCHEMA))
    every = {(r["doc_id"], bytes(r["leaf"])): (r["own"], r["above"]) for r in M.proofs(manifest).collect()}
    wanted = manifest.leaves.where("rank in (0, 17, 299)").select("tree", "rank")
    some = M.proofs(manifest, wanted).collect()
    assert len(some) == wanted.count() and len(some) > 20
    assert all(every[(r["doc_id"], bytes(r["leaf"]))] == (r["own"], r["above"]) for r in some)


def test_ranks_of_one_hot_key_are_dealt_over_ranges(spark):
    table = M.shared_table(spark.range(4000).select(F.lit("s").alias("source"), F.lit(1).alias("doc_id")), "t")
    got = M.ranked(table, ["source"], ["doc_id"], "r").select("rank", "n").collect()
    assert sorted(r["rank"] for r in got) == list(range(4000)) and {r["n"] for r in got} == {4000}
