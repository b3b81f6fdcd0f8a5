"""SimHash near-duplicates over a segment-popcount embedding.

A text's 64-bit fingerprint is the bitwise majority of the hashes of its word
shingles. Each fingerprint is embedded as the bit counts of its 32 two-bit
segments; the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints, so it is a lower bound to filter by.

The range join under that bound is a grid join. The segments are dealt into
blocks; with at most r differing counts, all but r blocks agree wholly, so two
near fingerprints share a cell in one of the grids over (blocks - r) blocks.
Cells are joined by key, their members filtered by the Manhattan bound and then
verified exactly. A cell gives back a spanning forest of its links, never all
pairs; a cell of more than CHUNK fingerprints is cut into chunks and every pair
of chunks becomes a task of its own, so no link is lost. Links are
closed to components by joins.

The embedding is kept in unary code (0: 00, 1: 01, 2: 11), in which Manhattan
distance is a bit count.

Defined results: null and empty texts have fingerprint 0 and are linked like
any other; texts are hashed whole; repeated rows and equal texts share a
fingerprint and so a component; a component whose doc_ids are all null has id null;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_table
from .graph import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
COMPARED = 100          # comparisons inside a cell that cost as much as one row of a grid
CHUNK = 1 << 16         # fingerprints of a cell that are compared in one task
SCAN = 192              # cells up to this size are compared by shifted vectors, larger ones by scans
PIECE = 1 << 20         # bytes of a text that are split into words at a time

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_LOW = 0x5555555555555555


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end at white space."""
    start = 0
    while start < len(raw):
        found = _SPACE.search(raw, start + PIECE)
        end = found.start() if found else len(raw)
        yield raw[start:end]
        start = end


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text's word k-shingles, as a signed integer."""
    if not text:
        return 0
    votes, n, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in pieces(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + piece.split()
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(),
                                                               ends[k - 1:].tolist())]
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
            tail = words[len(words) - k + 1:]
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        value = digest(b" ".join(tail), SEED)
        return value - (1 << 64) if value >> 63 else value
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, k: int = SHINGLE) -> Column:
    """A text column's fingerprints."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return simhash(text)


def embed(fp: Column) -> Column:
    """Unary code of the bit counts of the two-bit segments."""
    shifted = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def embed_array(fp: np.ndarray) -> np.ndarray:
    """`embed` over an array of unsigned integers."""
    shifted = fp >> np.uint64(1)
    low = np.uint64(_LOW)
    return ((fp | shifted) & low) | ((fp & shifted & low) << np.uint64(1))


def grid_masks(max_bits: int, blocks: int) -> list[int]:
    """One mask per grid: the segments of all but ``max_bits`` blocks, as signed integers."""
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are linked: the Manhattan bound first, the exact distance on what it leaves."""
    possible = np.bitwise_count(embed_array(a) ^ embed_array(b)) <= max_bits
    return possible & (np.bitwise_count(a ^ b) <= max_bits)


def link_scan(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of one large cell, as index pairs: each link found takes a member off the list."""
    t = embed_array(fps)
    left = np.arange(len(fps))
    forest = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            c = queue.pop()
            hit = np.bitwise_count(t[left] ^ t[c]) <= max_bits
            if hit.any():
                at = np.flatnonzero(hit)
                at = at[np.bitwise_count(fps[left[at]] ^ fps[c]) <= max_bits]
                found = left[at]
                forest += [(c, int(i)) for i in found]
                queue += found.tolist()
                left = np.delete(left, at)
    return forest


def forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each vertex's component, by propagation with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return label


def link_cells(cell: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole cells that lie one after another."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    out_a, out_b = [], []
    for s, n in zip(starts[sizes > SCAN].tolist(), sizes[sizes > SCAN].tolist()):
        forest = link_scan(fps[s:s + n], max_bits)
        if forest:
            pairs = np.array(forest) + s
            out_a.append(fps[pairs[:, 0]])
            out_b.append(fps[pairs[:, 1]])
    # members of small cells, each with the number of members after it
    small = (sizes > 1) & (sizes <= SCAN)
    at = np.flatnonzero(np.repeat(small, sizes))
    after = np.repeat(starts + sizes, sizes)[at] - at - 1
    hits_a, hits_b, shift = [], [], 1
    while True:
        at = at[after >= shift]
        after = after[after >= shift]
        if not len(at):
            break
        hit = at[near(fps[at], fps[at + shift], max_bits)]
        hits_a.append(hit)
        hits_b.append(hit + shift)
        shift += 1
    if hits_a and sum(map(len, hits_a)):
        a, b = np.concatenate(hits_a), np.concatenate(hits_b)
        used, packed = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = forest_of(len(used), packed[:len(a)], packed[len(a):])
        moved = np.flatnonzero(label != np.arange(len(used)))
        out_a.append(fps[used[label[moved]]])
        out_b.append(fps[used[moved]])
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


_LINKS = "a long, b long, cell long, chunk int"


def _batch(a, b, cell=None, chunk=None) -> pa.RecordBatch:
    n = len(a)
    none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)),
         none[0] if cell is None else pa.array(cell), none[1] if chunk is None else pa.array(chunk, pa.int32())],
        names=["a", "b", "cell", "chunk"])


def _link_sorted(max_bits: int, chunk_size: int):
    """Link the cells of a partition sorted by cell; members of larger cells come out with their chunk."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        hot, passed = None, 0           # the cell that outgrew a task, and its members handed on

        def chunks(values):
            nonlocal passed
            numbers = (passed + np.arange(len(values))) // chunk_size
            passed += len(values)
            return _batch(values, values, np.full(len(values), hot), numbers.astype(np.int32))

        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(c, hot, side="right"))
                if n:
                    yield chunks(f[:n])
                c, f = c[n:], f[n:]
                if not len(c):
                    continue
                hot, passed = None, 0
            cell, fps = np.concatenate([cell, c]), np.concatenate([fps, f])
            if not len(cell):
                continue
            last = int(np.searchsorted(cell, cell[-1]))         # the last cell may go on
            if last:
                a, b = link_cells(cell[:last], fps[:last], max_bits)
                if len(a):
                    yield _batch(a, b)
                cell, fps = cell[last:], fps[last:]
            if len(cell) > chunk_size:
                hot, passed = int(cell[0]), 0
                yield chunks(fps)
                cell, fps = cell[:0], fps[:0]
        if len(cell):
            a, b = link_cells(cell, fps, max_bits)
            if len(a):
                yield _batch(a, b)

    return link


def blocks_for(n: int, max_bits: int) -> int:
    """The number of blocks with the least work for ``n`` random fingerprints.

    More blocks make more grids (a row each per fingerprint) but smaller cells: two random segments have equal
    counts with probability 3/8, so a cell of a grid over s segments holds n (3/8)^s of the others.
    """
    def work(blocks: int) -> float:
        grids = comb(blocks, max_bits)
        return grids * (1 + n * 0.375 ** (32 * (blocks - max_bits) / blocks) / COMPARED)
    return min(range(max_bits + 1, 17), key=work)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, chunk_size: int = CHUNK) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``max_bits`` of each other.

    fps: one long column fp, distinct. The links span every component but need not be all pairs.
    ``blocks`` follows from the number of fingerprints if not given; it changes the work, not what is linked.
    """
    blocks = blocks or blocks_for(fps.count(), max_bits)
    code = embed(F.col("fp"))
    masks = grid_masks(max_bits, blocks)
    cells = fps.select("fp", code.alias("code")).select(
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
        .alias("cell"), "fp")
    found = shared_table(cells.repartition("cell").sortWithinPartitions("cell")
                         .mapInArrow(_link_sorted(max_bits, chunk_size), _LINKS), "near")
    links = found.where("chunk is null").select("a", "b")
    hot = found.where("chunk is not null").select("cell", "chunk", F.col("a").alias("fp"))
    if hot.isEmpty():
        return links
    # every pair of chunks of a hot cell is a cell of its own, at most two chunks large
    last = hot.groupBy("cell").agg(F.max("chunk").alias("last"))
    dealt = (hot.join(last, "cell")
             .select("cell", "chunk", "fp", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
             .select(F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "fp"))
    more = (dealt.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(_link_sorted(max_bits, 2 * chunk_size + 1), _LINKS).where("chunk is null").select("a", "b"))
    return links.union(more)


def fingerprint_roots(classes: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """The rows of ``classes``, one per distinct fingerprint fp, with the root of their component."""
    roots = connected_components(near_links(classes.select("fp"), max_bits, blocks))
    return classes.join(roots, classes["fp"] == roots["vertex"], "left").select(
        *classes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    marked = shared_table(docs.select("doc_id", fingerprint_column(F.col("text"), k).alias("fp")), "fingerprints")
    # written tables on both sides: the join is a broadcast if the written size allows, else Spark splits a large component
    linked = shared_table(fingerprint_roots(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), max_bits, blocks), "linked")
    lowest = shared_table(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    found = linked.join(lowest, "root").select("fp", "component_id")
    return marked.join(found, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one per component, all columns kept.

    A null doc_id is larger than any other; of rows with the same id any one stays.
    """
    taken = {c.lower() for c in docs.columns}
    row, mark = (next(n for i in range(len(taken) + 1) if (n := f"_simhash_{c}{i}") not in taken) for c in ("row", "fp"))
    marked = shared_table(docs.withColumn(mark, fingerprint_column(F.col("text"), k))
                          .withColumn(row, F.monotonically_increasing_id()), "marked")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("row"))
    classes = marked.select(F.col(mark).alias("fp"), rank.alias("rank")).groupBy("fp").agg(F.min("rank").alias("first"))
    kept = fingerprint_roots(classes, max_bits, blocks).groupBy("root").agg(F.min("first").alias("first"))
    return marked.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
