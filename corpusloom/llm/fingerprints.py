"""Document fingerprints: SimHash over weighted terms, and block tables to search them.

The distinct words of a text are its terms; a term's weight grows with the
logarithm of its frequency and of its length, and its 256-bit hash votes with
that weight for or against every bit. Two fingerprints' likeness is the share
of equal bits.

All fingerprints within a Hamming radius are found by block tables. A table per block
leads with that block (the fingerprint permuted to begin there). With n blocks, two
fingerprints within radius r differ by at most r // n bits in one block, so a query looks up
its key in every table together with all keys that differ by so few bits, and what it
meets there is checked over all bits. A table's key with many more members than others is
salted: its members are dealt over several tasks and its queries copied to each. Matches
are pairs of distinct fingerprints; the rows that share a fingerprint are its members.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and likeness 1 to another such text; texts are read whole;
repeated rows and equal texts have equal fingerprints; rows are ordered by doc_id,
null first, and then by text, so the next document of a repeated id is its repeat; the
only row of a table is its own next document; a bit with equal votes is 0; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import shared_table

BITS = 256
RADIUS = 31             # a copy with one word in twenty replaced is about 22 bits away, unrelated texts about 120
WIDE_FROM = 1 << 24     # distinct fingerprints from which blocks have three bytes, before that two
SALT_FROM = 256         # members of one table key that are compared in one task, or HOT times the mean if that is more
HOT = 4
ROWS = 2_000            # rows handed back at a time

_WORDS = re.compile(r"\w+").findall


def fingerprint(text: str | None) -> bytes:
    """The 32-byte fingerprint of a whole text."""
    terms = Counter(_WORDS(text.lower())) if text else None
    if not terms:
        return bytes(BITS // 8)
    weight = np.array([(1 + math.log(n)) * math.log1p(len(t)) for t, n in terms.items()], dtype=np.float32)
    raw = [t.encode("utf-8", "surrogatepass") for t in terms]
    digests = b"".join([xxhash.xxh3_128_digest(t) + xxhash.xxh3_128_digest(t, 1) for t in raw])
    total = np.zeros(BITS, dtype=np.float64)
    block = np.frombuffer(digests, dtype=np.uint8).reshape(-1, BITS // 8)
    for a in range(0, len(block), 4096):
        total += weight[a:a + 4096] @ np.unpackbits(block[a:a + 4096], axis=1).astype(np.float32)
    return np.packbits(total > weight.sum(dtype=np.float64) / 2).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_EDGES = _EDITED + ", part int, first_text string, last_text string"


def _edited_row(doc_id, text, mark, following, following_mark):
    changed = edited(text, following)
    changed_mark = mark if changed == text else fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark.hex(),
            changed_mark.hex(), likeness(mark, changed_mark), likeness(mark, following_mark))


def _edit_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition against the next; the last row waits, with the first text, for its neighbour."""
    names = [f.split()[0] for f in _EDGES.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]
             for f in _EDGES.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows, first, held = [], None, None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            mark = fingerprint(text)
            if held is None:
                first = text
            else:
                rows.append((*_edited_row(*held, text, mark), None, None, None))
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
            held = (doc_id, text, mark)
    if held is not None:
        rows.append((held[0], len(held[1]), None, None, None, None, None, TaskContext.get().partitionId(),
                     first, held[1]))
    if rows:
        yield batch_of(rows)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that text and to the next document.

    One range shuffle by doc_id brings neighbours together. The last document of a
    partition is finished in a second, small step: one row per partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the beginning of the text deals out rows of one doc_id, or of none, in their order
    done = shared_table(order.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64))
                        .sortWithinPartitions("doc_id", "text").mapInArrow(_edit_partition, _EDGES), "edited")
    ends = done.where("part is not null").select("part", "doc_id", F.col("last_text").alias("text"), "first_text")
    # one number per partition of the shuffle
    line = W.orderBy("part")
    after = ends.select("part").select("part", F.coalesce(
        F.lead("part").over(line), F.first("part").over(line)).alias("next"))
    ends = (ends.join(after, "part").select("doc_id", "text", "next")
            .join(ends.select(F.col("part").alias("next"), F.col("first_text").alias("following")), "next")
            .select("doc_id", "text", "following"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_edited_row(None if pd.isna(i) else int(i), t, fingerprint(t), f, fingerprint(f))
                    for i, t, f in zip(batch["doc_id"], batch["text"], batch["following"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EDITED.split(", ")]).astype({"doc_id": "Int64"})

    columns = [c.split()[0] for c in _EDITED.split(", ")]
    return done.where("part is null").select(columns).union(ends.mapInPandas(finish, _EDITED))


@dataclass(frozen=True)
class Blocks:
    """Byte ranges of the tables' leading blocks, and how many bits a query's keys may differ there."""
    starts: tuple[int, ...]
    widths: tuple[int, ...]
    errors: tuple[int, ...]


def blocks_for(radius: int, width: int) -> Blocks:
    """Blocks of ``width`` bytes such that fingerprints within the radius differ in one by no more than its errors."""
    starts = tuple(range(0, BITS // 8, width))
    widths = tuple(min(width, BITS // 8 - a) for a in starts)
    most = radius // len(starts)
    # if every block exceeded its errors, the distance would exceed the radius; the last block gives up what that leaves over
    spare = len(starts) * (most + 1) - (radius + 1)
    return Blocks(starts, widths, (*[most] * (len(starts) - 1), most - min(spare, most)))


def _flips(bits: int, errors: int) -> list[int]:
    """All numbers of ``bits`` bits of which at most ``errors`` are set."""
    return [sum(1 << b for b in some) for n in range(errors + 1) for some in combinations(range(bits), n)]


def _near_in_cells(radius: int, blocks: Blocks):
    """The members of each cell within the radius of its queries: every pair in the first block that it shares."""
    starts, errors = np.array(blocks.starts), np.array(blocks.errors)

    def pairs_of(queries: np.ndarray, members: np.ndarray, block: int):
        step = max(1, (1 << 16) // len(queries))
        for a in range(0, len(members), step):
            apart = np.bitwise_count(members[a:a + step, None, :] ^ queries[None, :, :])
            bits = apart.sum(axis=2)
            m, q = np.nonzero(bits <= radius)
            if len(m):
                shares = np.add.reduceat(apart[m, q], starts, axis=1) <= errors
                first = shares.argmax(axis=1) == block
                yield from zip(q[first].tolist(), (a + m[first]).tolist(), bits[m[first], q[first]].tolist())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, int, int]]:
        cell, queries = None, None
        for batch in batches:
            if not len(batch):
                continue
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.column(3).to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                new = int(asked[a:b].sum())     # queries of a cell come before its members
                if cells[a] != cell:
                    cell, queries = cells[a], marks[a:a + new]
                elif new:
                    queries = np.concatenate([queries, marks[a:a + new]])
                if len(queries) and a + new < b:
                    members = marks[a + new:b]
                    for q, m, bits in pairs_of(queries, members, int(batch.column(4)[a].as_py())):
                        yield queries[q].tobytes(), members[m].tobytes(), bits, int(n[a + new + m])

    return near


def _pairs(near):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = near(batches)
        while rows := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.binary(), pa.binary(), pa.int32(), pa.int64()))], names=["fp", "member", "bits", "n"])
    return pairs


def _counts(near):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()),
                                               pa.array(list(totals.values()), pa.int64())], names=["fp", "n"])

        for mark, _, _, n in near(batches):
            totals[mark] = totals.get(mark, 0) + n
            if len(totals) > 50_000:
                yield batch_of()
                totals.clear()
        if totals:
            yield batch_of()
    return counts


def _cells(marked: DataFrame, asked: DataFrame, radius: int, width: int | None, salt_from: int):
    """The rows of the block tables and the queries, dealt by cell (table and key), queries first; and the blocks."""
    members = shared_table(marked.groupBy("fingerprint").agg(F.count("*").alias("n")), "classes")
    blocks = blocks_for(radius, width or (3 if members.count() > WIDE_FROM else 2))

    def key(i: int):
        part = F.substring("fingerprint", 1 + 2 * blocks.starts[i], 2 * blocks.widths[i])
        return F.conv(part, 16, 10).cast("long") + F.lit(i << 24)

    n_blocks = range(len(blocks.starts))
    queries = asked.select("fingerprint").distinct()

    def keys_near(i: int):
        flips = F.array(*[F.lit(m).cast("long") for m in _flips(8 * blocks.widths[i], blocks.errors[i])])
        return F.transform(flips, lambda m: key(i).bitwiseXOR(m))

    met = queries.select(F.unhex("fingerprint").alias("fp"),
                         F.explode(F.flatten(F.array(*[keys_near(i) for i in n_blocks]))).alias("cell"))
    met = shared_table(met.select("cell", F.lit(True).alias("is_query"), "fp", F.lit(0).cast("long").alias("n")), "queries")
    listed = members.select(F.explode(F.array(*[key(i) for i in n_blocks])).alias("cell"), F.lit(False).alias("is_query"),
                            F.unhex("fingerprint").alias("fp"), "n")
    # every member goes to its cell in each table, met or not: as many rows as there are fingerprints and tables
    sizes = listed.groupBy("cell").count()
    mean = sizes.agg(F.avg("count")).first()[0] or 0
    most = max(salt_from, int(HOT * mean))
    hot = sizes.where(F.col("count") > most).select(
        F.col("cell"), F.ceil(F.col("count") / most).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = listed.join(hot, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), salts).cast("int"))
    copied = met.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    columns = [(F.col("cell") + F.col("salt").cast("long") * (1 << 32)).alias("cell"), "is_query", "fp", "n",
               F.shiftright("cell", 24).cast("int").alias("block")]
    return (salted.select(columns).union(copied.select(columns)).repartition("cell")
            .sortWithinPartitions("cell", F.desc("is_query"))), blocks


def near_matches(marked: DataFrame, asked: DataFrame, radius: int = RADIUS, width: int | None = None,
                 salt_from: int = SALT_FROM) -> DataFrame:
    """(fingerprint, member, bits, n): for each asked fingerprint, all fingerprints of ``marked`` within the radius.

    marked, asked: a hex column ``fingerprint``, by which they are joined to get the rows
    of either side. bits: the distance; n: the rows of ``marked`` with the fingerprint ``member``.
    """
    cells, blocks = _cells(marked, asked, radius, width, salt_from)
    found = cells.mapInArrow(_pairs(_near_in_cells(radius, blocks)), "fp binary, member binary, bits int, n long")
    return found.select(F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("member")).alias("member"), "bits", "n")


def near_counts(marked: DataFrame, asked: DataFrame, radius: int = RADIUS, width: int | None = None,
                salt_from: int = SALT_FROM) -> DataFrame:
    """(fingerprint, n): for each asked fingerprint, the number of rows that `near_matches` finds, added up where they are met."""
    cells, blocks = _cells(marked, asked, radius, width, salt_from)
    found = cells.mapInArrow(_counts(_near_in_cells(radius, blocks)), "fp binary, n long")
    return found.groupBy(F.lower(F.hex("fp")).alias("fingerprint")).agg(F.sum("n").alias("n"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Columns of `edited_likeness`, and n_near.

    n_near: for rows whose doc_id is divisible by 100, the number of other rows with a
    fingerprint within ``radius`` bits; null for the rest.
    """
    marked = shared_table(edited_likeness(docs), "marked")
    is_query = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    asked = marked.where(is_query)
    counts = near_counts(marked, asked, radius)
    answered = asked.join(counts, "fingerprint").select(*marked.columns, (F.col("n") - 1).alias("n_near"))
    return marked.where(~is_query).withColumn("n_near", F.lit(None).cast("long")).union(answered)
