"""Vector code compression: product codebooks with an equal-average search for the nearest entry.

Components become integers, floor(4096 * x); a vector is cut into equal consecutive parts, and each part
position has a codebook of a few entries. Nearest entries are found by the equal-average method: entries lie
sorted by their component sum, the search starts where a part's own sum would stand and goes outward on both
sides; a side is closed as soon as (difference of the sums)^2 / dimension strictly exceeds the least squared
distance so far, which bounds every entry further out (Cauchy-Schwarz). Ties go to the entry with the lower
number, so entries whose bound only equals the best distance are still looked at.

Training is a few passes over all vectors: tasks assign their parts and add up sums and counts by (part,
entry, position), Spark adds those over the tasks, and the entries are replaced. The driver holds the
codebooks alone (entries x dimension). Nothing is sampled; a lost executor costs the tasks it ran.

Defined results: rows are dropped whose vector is null or holds null or non-finite components. Codebooks
start from the vectors with the smallest ids; null ids found no entry, equal ids go by their components;
if there are fewer vectors than entries, there are as many entries as vectors, and if all ids are null, none
and no rows. The dimension is that of the smallest id; vectors of another length are dropped. A dimension that
the parts don't divide is filled up with zeros, which changes no distance. Integers are held within
+-`limit(d)`, for parts of 8 components +-2^24 (x within +-4096), so that 64-bit sums of squares can't overflow.
Repeated rows are rows of their own. An empty table gives no rows. Other columns are ignored or, by `keep`, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import shared_table

PARTS = 8
ENTRIES = 16            # at most 256: a code has two hex digits a part
ROUNDS = 6
SCALE = 4096


def limit(d: int) -> int:
    """Largest component whose squared distances in d dimensions, times d, stay within 64 bits."""
    return 1 << max(1, min(24, 29 - max(d - 1, 1).bit_length()))


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite numbers only."""
    return vectors.where(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))


def integer_parts(column: pa.Array, dimension: int, parts: int) -> np.ndarray:
    """A batch's vectors as integers: (rows, parts, components of a part)."""
    d = -(-dimension // parts)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)
    most = limit(d)
    whole = np.zeros((len(column), parts * d), dtype=np.int64)
    whole[:, :dimension] = np.clip(np.floor(values * SCALE), -most, most)
    return whole.reshape(len(column), parts, d)


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest entry and the squared distance, by the equal-average search."""
    n, d = vectors.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    own = vectors.sum(axis=1)
    best = np.full(n, (1 << 62) // max(d, 1), dtype=np.int64)
    number = np.full(n, len(book), dtype=np.int64)
    place = np.searchsorted(sums, own)
    sides = [[1, place.copy(), np.flatnonzero(place < len(book))], [-1, place - 1, np.flatnonzero(place > 0)]]
    while any(len(side[2]) for side in sides):
        for side in sides:
            step, at, rows = side
            gap = own[rows] - sums[at[rows]]
            rows = rows[gap * gap <= best[rows] * d]            # others have closed this side
            entry = at[rows]
            difference = vectors[rows] - entries[entry]
            distance = np.einsum("ij,ij->i", difference, difference)
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (order[entry] < number[rows]))
            best[rows[nearer]] = distance[nearer]
            number[rows[nearer]] = order[entry[nearer]]
            at[rows] += step
            side[2] = rows[(at[rows] >= 0) & (at[rows] < len(book))]
    return number, best


def assigned(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances of a batch, each (rows, parts)."""
    found = [nearest(parts[:, p], books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _founders(kept: DataFrame, id_col: str, vector_col: str, entries: int) -> tuple[int, pa.Array] | None:
    """Dimension and vectors of the smallest ids (at most ``entries`` rows)."""
    named = kept.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    first = named.orderBy("id", "v").limit(1).collect()
    if not first:
        return None
    dimension = len(first[0]["v"])
    rows = named.where(F.size("v") == dimension).orderBy("id", "v").limit(entries).collect()
    return dimension, pa.array([r["v"] for r in rows], type=pa.list_(pa.float64()))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
                  entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray] | None:
    """(dimension, codebooks as integers of shape parts, entries, components); None without vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = usable(vectors, vector_col)
    found = _founders(kept, id_col, vector_col, entries)
    if found is None:
        return None
    dimension, first = found
    books = np.ascontiguousarray(integer_parts(first, dimension, parts).transpose(1, 0, 2))
    d = books.shape[2]
    kept = kept.where(F.size(vector_col) == dimension).select(vector_col)

    def totals(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(books.shape, dtype=np.int64)
            count = np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                cut = integer_parts(batch.column(0), dimension, parts)
                numbers, _ = assigned(cut, books)
                for p in range(parts):
                    one = (numbers[:, p, None] == np.arange(books.shape[1])).astype(np.float64)
                    # exact: a batch's sums of components within 2^24 stay under 2^53
                    total[p] += (one.T @ cut[:, p].astype(np.float64)).astype(np.int64)
                    count[p] += one.sum(axis=0).astype(np.int64)
            part, entry, place = (i.ravel() for i in np.indices(total.shape))
            used = count[part, entry] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[used], pa.int64()) for x in (
                part, entry, place, total.ravel(), count[part, entry])], ["part", "entry", "place", "total", "n"])
        return run

    for _ in range(rounds if d else 0):
        rows = (kept.mapInArrow(totals(books), "part long, entry long, place long, total long, n long")
                .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
        books = books.copy()
        for r in rows:          # parts * entries * components rows at most
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return dimension, books


def encode_vectors(vectors: DataFrame, model: tuple[int, np.ndarray] | None, vector_col: str = "embedding",
                   keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The ``keep`` columns of every usable vector with its code and error (squared distances over all parts)."""
    kept = usable(vectors, vector_col)
    fields = [kept.schema[c] for c in keep]
    dimension, books = model if model else (-1, np.zeros((PARTS, 0, 0), dtype=np.int64))
    parts = len(books)
    kept = kept.where(F.size(vector_col) == dimension).select(*keep, F.col(vector_col).alias("_vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = assigned(integer_parts(batch.column(len(keep)), dimension, parts), books)
            codes = [row.tobytes().hex() for row in numbers.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(codes, pa.string()),
                 pa.array(distances.sum(axis=1), pa.int64())], [*keep, "code", "error"])

    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.mapInArrow(run, schema)


def decode_vectors(codes: DataFrame, model: tuple[int, np.ndarray], code_col: str = "code") -> DataFrame:
    """``codes`` with ``decoded``: the vector that each code stands for."""
    dimension, books = model
    parts = len(books)
    flat = (books / SCALE).tolist()

    @F.pandas_udf("array<double>")
    def expand(batch):
        return batch.map(lambda code: None if code is None else [
            x for p, e in enumerate(bytes.fromhex(code)[:parts]) for x in flat[p][e]][:dimension])

    return codes.withColumn("decoded", expand(F.col(code_col)))


def codebooks_digest(model: tuple[int, np.ndarray] | None) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, model[1].ravel().tolist() if model else ())).encode()).hexdigest()


def compressed_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256.

    The codes are written once. Sums of a label are added up before the shuffle; their table joins back
    as a broadcast if its written size allows, else by a join whose hot labels Spark splits.
    """
    model = fit_codebooks(vectors)
    coded = shared_table(encode_vectors(vectors, model), "vector-codes")
    by_label = shared_table(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")),
                            "label-errors")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(model)).alias("codebooks_sha256"))


def compressed_vectors_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of `compressed_vectors`: plain nearest entries over unrolled rounds; dimensions that parts divide."""
    def near(r: int) -> str:
        return f"""near{r} AS MATERIALIZED (SELECT k, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT c.k, c.p, b.e, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
  FROM cut c JOIN book{r} b USING (p)) GROUP BY k, p)"""

    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""cut AS MATERIALIZED (SELECT k, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v
  FROM kept, range({parts}) t(p))""",
            f"book0 AS MATERIALIZED (SELECT p, k - 1 AS e, v FROM cut WHERE k <= {entries})"]
    for r in range(rounds):
        ctes += [near(r), f"""book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
    SELECT p, e, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (
      SELECT c.p, a.e, unnest(c.v) AS x, unnest(range(len(c.v))) AS i FROM cut c JOIN near{r} a USING (k, p))
    GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""]
    ctes += [near(rounds), f"""digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
  SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM book{rounds}))""",
             f"""coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
  FROM near{rounds} GROUP BY k)"""]
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), digest"""
