"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from the root.

Every document is a leaf; the leaves of a source, by ascending doc_id, are hashed in runs of `FAN` until one node is
left (the subroot), and the subroots, by source, likewise give the root. The manifest is a store of records digest ->
children digests, one table per level. A leaf is requested by its rank: its digits in base `FAN` say which child to
take on the way down from the root. At each step the requests are joined with the store by digest, the children
that aren't taken become a segment of the path, and at the leaf the segments are reversed, which gives the proof
from leaf to root. Requests that share their leading digits descend as one row and part where their digits part,
so a level has no more rows than nodes, and the last one a row for each run of leaves.

Ranks are found without gathering a source in one task: rows are dealt out by range over (source, doc_id, leaf), numbered inside
their range, and counts of the ranges before give the offsets. Everything is DataFrame functions; levels and ranges are
written tables, so a lost executor costs part of a level.

Defined results: a null field is hashed as `-`, so a null text and an empty one differ; null doc_ids come first in their source,
the null source comes before all others; rows with equal source and doc_id go by their leaf digest; repeated rows are
leaves of their own with equal digests (the store holds equal records once). An empty table gives no rows.
A null doc_id is never tampered with. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_table

FAN = 16
RANGE_ROWS = 1 << 18        # narrow rows that one range of the ranking holds on average
TAMPER = 5                  # documents whose crc32(doc_id) this divides are tampered with
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(digest: Column | str) -> Column:
    """The hex text of binary digests (of one, or of many put together)."""
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """Binary SHA-256."""
    return F.unhex(F.sha2(text, 256))


def leaf_digest(row: dict[str, Column]) -> Column:
    """A leaf: every field as its byte count, a colon and its text."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return hashed(F.concat(*[field(row[f]) for f in FIELDS]))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, and ``shown``: the leaf of the row as a reader may find it, tampered with or not."""
    row = {f: F.col(f) for f in FIELDS}
    tampered = {**row, "text": F.translate("text", _UPPER, _LOWER)}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, F.lit(False))
    leaf = leaf_digest(row)
    return docs.select("source", "doc_id", leaf.alias("leaf"),
                       F.when(hit, leaf_digest(tampered)).otherwise(leaf).alias("shown"))


def ranked(table: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """A written table with ``rank`` (from 0) by ``order`` inside each group, and ``n``, the group's rows."""
    spark = table.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + table.count() // RANGE_ROWS)
    # the last key parts rows that are equal in all others, so that no range must hold them all
    ranges = shared_table(table.withColumn("tie", F.monotonically_increasing_id())
                          .repartitionByRange(parts, *group, *order, "tie").withColumn("part", F.spark_partition_id()), name)
    counts = ranges.groupBy("part", *group).agg(F.count("*").alias("rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = shared_table(counts.select(
        F.col("part").alias("o_part"), *[F.col(g).alias(f"o_{g}") for g in group],
        (F.sum("rows").over(before) - F.col("rows")).alias("before"),
        F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")), f"{name}-offsets")
    numbered = ranges.withColumn("here", F.row_number().over(Window.partitionBy("part", *group).orderBy(*order, "tie")) - 1)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"o_{g}")) for g in group], F.col("part") == F.col("o_part"))
    return numbered.join(offsets, same).select(*table.columns, (F.col("here") + F.col("before")).alias("rank"), "n")


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, n, digest): written tables tree, idx, n, digest, children.

    A tree whose level has one node is finished and goes no further.
    """
    levels = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        up = (nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"))
              .agg(F.max("n").alias("n"), F.array_join(F.transform(run, lambda k: text_of(k["digest"])), "").alias("children"))
              .select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
                      hashed(F.col("children")).alias("digest"), F.unhex("children").alias("children")))
        nodes = shared_table(up, f"{name}-{len(levels) + 1}")
        levels.append(nodes)
        most = (most + FAN - 1) // FAN
    return levels


@dataclass
class Manifest:
    """leaves: source, doc_id, leaf, shown, tree, rank, n; sources: source, tree, depth, subroot.

    levels[i] and top[i] are the records of level i + 1 of the sources' trees and of the tree over their subroots.
    """
    leaves: DataFrame
    sources: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def build_manifest(docs: DataFrame) -> Manifest:
    """Hash every document and write the DAG."""
    leaves = shared_table(ranked(shared_table(leaf_rows(docs), "leaves"), ["source"], ["doc_id", "leaf"], "ranges"), "ranked")
    trees = ranked(shared_table(leaves.select("source").distinct(), "sources"), [], ["source"], "source-ranges")
    trees = shared_table(trees.select(F.col("source").alias("t_source"), F.col("rank").alias("tree"), F.col("n").alias("trees")), "trees")
    leaves = leaves.join(trees.drop("trees"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    nodes = leaves.select("tree", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest"))
    levels = grow(nodes, "level")
    done = [level.where("n = 1").select("tree", F.lit(depth).alias("depth"), F.col("digest").alias("subroot"))
            for depth, level in enumerate([nodes, *levels])]
    sources = shared_table(reduce(DataFrame.union, done).join(trees, "tree"), "subroots")
    subroots = sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"),
                              F.col("subroot").alias("digest"))
    top = grow(subroots, "top")
    last = (top[-1] if top else subroots).where("n = 1").select("digest").first()
    return Manifest(leaves, sources, levels, top, bytes(last["digest"]) if last else None)


def children_of(requests: DataFrame, level: DataFrame) -> DataFrame:
    """Requests (tree, idx, digest, path, ...) with the children that the store has for their digest."""
    return requests.join(level.groupBy("digest").agg(F.first("children").alias("children")), "digest").drop("digest")


def taken(children: str, digit: Column) -> tuple[Column, Column]:
    """The child that a digit takes, and the segment of those left: (before it, after it)."""
    c, at = F.col(children), digit.cast("int") * 32
    return F.substring(c, at + 1, F.lit(32)), F.struct(
        F.substring(c, F.lit(1), at).alias("left"), F.substring(c, at + 33, F.length(c)).alias("right"))


def step_down(requests: DataFrame, level: DataFrame, below: int, wanted: DataFrame | None) -> DataFrame:
    """One row per child that a wanted leaf lies under."""
    rest = [c for c in requests.columns if c not in ("idx", "digest", "path")]
    child, segment = taken("children", F.col("digit"))
    down = (children_of(requests, level)
            .withColumn("digit", F.explode(F.sequence(F.lit(0), F.expr("length(children) div 32 - 1").cast("int"))))
            .select(*rest, (F.col("idx") * FAN + F.col("digit")).alias("idx"), child.alias("digest"),
                    F.array_append("path", segment).alias("path")))
    if wanted is None:
        return down
    prefixes = wanted.select("tree", F.expr(f"rank div {FAN ** below}L").alias("idx")).distinct()
    return down.join(prefixes, ["tree", "idx"], "left_semi")


_PATH = "array<struct<left:binary,right:binary>>"


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Every leaf's proof, or that of the ``wanted`` ones (tree, rank).

    doc_id, leaf, shown, subroot, ``own`` (the segment beside the leaf, null for a lone leaf) and ``above``: the segments over
    it up to the root, as hex text.
    """
    leaves = manifest.leaves if wanted is None else manifest.leaves.join(wanted, ["tree", "rank"], "left_semi")
    sources = manifest.sources if wanted is None else manifest.sources.join(wanted, "tree", "left_semi")
    spark = leaves.sparkSession
    if manifest.root is None:
        start = spark.createDataFrame([], f"tree long, idx long, digest binary, path {_PATH}")
    else:
        start = spark.createDataFrame([(0, 0, manifest.root, [])], f"tree long, idx long, digest binary, path {_PATH}")
    trees = None if wanted is None else sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"))
    for below in range(len(manifest.top) - 1, -1, -1):
        start = step_down(start, manifest.top[below], below, trees)
    # each source's requests begin at the subroot, on the level that its tree reaches
    begin = start.select(F.col("idx").alias("tree"), "digest", "path").join(sources.select("tree", "depth"), "tree").select(
        "tree", F.lit(0).cast("long").alias("idx"), "digest", "path", F.col("digest").alias("subroot"), "depth")

    def at(level: int) -> DataFrame:
        return begin.where(F.col("depth") == level).drop("depth")

    above = F.transform(F.reverse("path"), lambda s: F.struct(text_of(s["left"]).alias("left"), text_of(s["right"]).alias("right")))
    lone = at(0).join(leaves, "tree").select("doc_id", "leaf", "shown", "subroot", F.lit(None).cast(
        "struct<left:string,right:string>").alias("own"), above.alias("above"))
    if not manifest.levels:
        return lone
    now = at(len(manifest.levels))
    for below in range(len(manifest.levels) - 1, 0, -1):
        now = step_down(now, manifest.levels[below], below, wanted).unionByName(at(below))
    runs = leaves.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN}").alias("idx")).agg(
        F.collect_list(F.struct("rank", "doc_id", "leaf", "shown")).alias("run"))
    child, segment = taken("children", F.col("one.rank") % FAN)
    found = (children_of(now, manifest.levels[0]).join(runs, ["tree", "idx"])
             .select("subroot", "children", above.alias("above"), "run")
             .select("subroot", "children", "above", F.explode("run").alias("one"))
             .withColumn("child", child).withColumn("own", segment)
             # the descent ends at the very leaf that was asked for
             .where(F.col("child") == F.col("one.leaf")))
    return found.select("one.doc_id", "one.leaf", "one.shown", "subroot", F.struct(
        text_of("own.left").alias("left"), text_of("own.right").alias("right")).alias("own"), "above").union(lone)


def folded(leaf: Column) -> Column:
    """The root that a leaf (hex text) and the segments of `proofs` give."""
    def up(h: Column, s: Column) -> Column:
        return F.sha2(F.concat(s["left"], h, s["right"]), 256)
    return F.aggregate("above", F.when(F.col("own").isNull(), leaf).otherwise(up(leaf, F.col("own"))), up)


def verified_documents(docs: DataFrame) -> DataFrame:
    """Proof and verification of every document: the contract's columns."""
    manifest = build_manifest(docs)
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    siblings = F.concat(F.coalesce(F.concat("own.left", "own.right"), F.lit("")),
                        F.array_join(F.transform("above", lambda s: F.concat(s["left"], s["right"])), ""))
    rows = proofs(manifest).select("doc_id", text_of("leaf").alias("leaf"), text_of("subroot").alias("subroot"),
                                   root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
                                   folded(text_of("shown")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: 0::BIGINT),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def verified_documents_sql(levels: int = 5, top: int = 4) -> str:
    """DuckDB SQL of `verified_documents` for sources of at most FAN ** levels rows and FAN ** top sources."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if f == 'text' else f) for f in FIELDS)})"

    ctes = [f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (
    SELECT row_number() OVER () AS k, doc_id, source, {leaf('text')} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % {TAMPER} = 0
      THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf('text')} END AS shown FROM documents))""",
            "s0 AS MATERIALIZED (SELECT tree, rank AS idx, leaf AS h, n FROM leaves)",
            "p0 AS (SELECT k, tree, rank AS idx, shown AS h, '' AS proof FROM leaves)"]

    def tower(s: str, p: str, first: int, count: int) -> str:
        for i in range(first, first + count):
            # finished trees (one node) pass unchanged
            ctes.append(f"""{s}{i + 1} AS MATERIALIZED (
  SELECT tree, idx // {FAN} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, max((n + {FAN - 1}) // {FAN}) AS n FROM {s}{i} WHERE n > 1
  GROUP BY tree, idx // {FAN} UNION ALL SELECT tree, idx, h, n FROM {s}{i} WHERE n = 1)""")
            ctes.append(f"""{p}{i + 1} AS MATERIALIZED (
  SELECT p.k, p.tree, p.idx // {FAN} AS idx, any_value(p.proof) || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> p.idx), '') AS proof,
    sha256(string_agg(CASE WHEN s.idx = p.idx THEN p.h ELSE s.h END, '' ORDER BY s.idx)) AS h
  FROM {p}{i} p JOIN {s}{i} s ON s.tree = p.tree AND s.idx // {FAN} = p.idx // {FAN} WHERE s.n > 1 GROUP BY p.k, p.tree, p.idx
  UNION ALL BY NAME SELECT p.* FROM {p}{i} p JOIN {s}{i} s ON s.tree = p.tree AND s.idx = p.idx WHERE s.n = 1)""")
        return f"{first + count}"

    end = tower("s", "p", 0, levels)
    ctes += [f"t0 AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, h, count(*) OVER () AS n FROM s{end})",
             f"q0 AS (SELECT k, 0 AS tree, tree AS idx, h, proof FROM p{end})"]
    last = tower("t", "q", 0, top)
    return f"""WITH {', '.join(ctes)}
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = t.h AS verified
FROM leaves l JOIN q{last} q ON q.k = l.k JOIN s{end} s ON s.tree = l.tree CROSS JOIN t{last} t"""
