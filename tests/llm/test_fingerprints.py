import hashlib
import random

import pytest

from corpusloom.llm import fingerprints as P
from tests.conftest import SF001


def test_edited_text():
    assert P.edited("abcdefg", "XY") == "abcdXY"
    assert P.edited("abcdefg", "UVWXYZ") == "abcdUVW"
    assert P.edited("", "abc") == "" and P.edited("a", "b") == "a"


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted(P.document_fingerprints(docs.repartition(5)).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    marks = [P.fingerprint(t) for t in texts]
    for i, r in enumerate(rows):
        after = (i + 1) % len(texts)
        changed = P.edited(texts[i], texts[after])
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (marks[i].hex(), P.fingerprint(changed).hex())
        assert r["near_edited"] == P.likeness(marks[i], P.fingerprint(changed))
        assert r["near_next"] == P.likeness(marks[i], marks[after])
        near = sum(P.likeness(marks[i], m) >= 1 - P.RADIUS / P.BITS for m in marks) - 1
        assert r["n_near"] == (near if r["doc_id"] % 100 == 0 else None)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("radius, width", [(31, 2), (31, 3), (7, 2), (0, 2), (40, 3)])
def test_blocks_leave_no_pair_out(radius, width):
    blocks = P.blocks_for(radius, width)
    assert sum(blocks.widths) == P.BITS // 8 and min(blocks.errors) >= 0
    assert sum(e + 1 for e in blocks.errors) > radius


@pytest.mark.parametrize("radius, width, salt_from", [(31, 2, 1 << 15), (31, 2, 4), (31, 3, 256), (7, 2, 4)])
def test_block_tables_find_all_within_the_radius(spark, radius, width, salt_from):
    rng = random.Random(4)
    centres = [rng.getrandbits(256) for _ in range(5)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(256), rng.randint(0, 22))) for c in centres for _ in range(30)]
    fps += centres * 2 + [rng.getrandbits(256) for _ in range(50)] + [0, 0, 1]
    df = spark.createDataFrame([(f"{f:064x}",) for f in fps], "fingerprint string")
    asked = spark.createDataFrame([(f"{f:064x}",) for f in fps[::3]], "fingerprint string")
    got = sorted(tuple(r) for r in P.near_matches(df, asked, radius, width, salt_from).collect())
    expected = sorted((f"{q:064x}", f"{m:064x}", (q ^ m).bit_count(), fps.count(m))
                      for q in set(fps[::3]) for m in set(fps) if (q ^ m).bit_count() <= radius)
    assert got == expected and any(0 < r[2] for r in got)
    counts = {r["fingerprint"]: r["n"] for r in P.near_counts(df, asked, radius, width, salt_from).collect()}
    assert counts == {q: sum(r[3] for r in expected if r[0] == q) for q in {r[0] for r in expected}}


def test_rows_of_the_block_tables_follow_the_fingerprints(spark):
    """Every fingerprint has one row per table, however many cells the queries look up; a join of the two would grow with both."""
    rng = random.Random(6)
    for n, n_asked in ((300, 3), (300, 100)):
        fps = [rng.getrandbits(256) for _ in range(n)]
        df = spark.createDataFrame([(f"{f:064x}",) for f in fps], "fingerprint string")
        asked = df.where(df.fingerprint.isin([f"{f:064x}" for f in fps[:n_asked]]))
        cells, blocks = P._cells(df, asked, P.RADIUS, 2, P.SALT_FROM)
        assert cells.where("not is_query").count() == n * len(blocks.starts)
        assert cells.where("is_query").count() == n_asked * sum(
            len(P._flips(8 * w, e)) for w, e in zip(blocks.widths, blocks.errors))


def test_recall_on_edited_copies(spark):
    """Nine of ten copies with up to one word in twenty replaced are within the radius, and no unrelated text is."""
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    some = [t for t in texts if t and 150 <= len(t.split()) <= 400]
    words = [w for t in some for w in t.split()]
    for share in (0.005, 0.02, 0.05):
        copies = [" ".join(rng.choice(words) if rng.random() < share else w for w in t.split()) for t in some]
        near = [P.likeness(P.fingerprint(t), P.fingerprint(c)) >= 1 - P.RADIUS / P.BITS for t, c in zip(some, copies)]
        print(share, len(near), sum(near) / len(near))
        assert sum(near) >= 0.9 * len(near)


def test_repeated_and_missing_ids_are_dealt_out(spark):
    texts = [f"text number {i} of a repeated id" for i in range(200)]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = P.edited_likeness(docs.repartition(3)).collect()
    order = sorted(texts[1::2]) + sorted(texts[::2])
    expected = {P.fingerprint(t).hex(): hashlib.sha256(P.edited(t, order[(i + 1) % 200]).encode()).hexdigest()
                for i, t in enumerate(order)}
    assert {r["fingerprint"]: r["edited_sha256"] for r in rows} == expected and len(rows) == 200


def test_one_document(spark):
    row = P.document_fingerprints(spark.createDataFrame([(0, "only one here")], "doc_id long, text string")).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0 and row[0]["n_near"] == 0
