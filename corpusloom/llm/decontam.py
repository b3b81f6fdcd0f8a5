"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds one posting (term, row, position) per training token whose term
occurs in the test items, and a head per document with its number of words. Each
file of the index is sorted by term, so a term's postings lie together.

A phrase is found from its rarest terms: for every window of a test item the two
terms with the shortest posting lists are taken, their postings are shifted by their
offset in the item, and the shifted lists are intersected; what is left are
alignments of an item with a document. Each alignment is then checked term by
term against the postings of the documents that have one, and runs of matching
positions at least as long as a window are occurrences.

A proximity match is a stretch of a document, twice as long as a window, with all
distinct terms of a tile of an item but at most one in five, in any order. Tiles are
windows side by side, the last one ending with the item, so a copied passage of two
windows' length holds a whole tile. A stretch that lacks at most x of a tile's terms
holds at least r of its x + r rarest terms, whichever are missing; stretches with that many
of them are the candidates, and each is checked against all terms of its tile.

Defined results: null and empty texts have no words and no hits; a repeated row is
a document of its own; of repeated item ids each text counts, the id once; an item
with null id hits words but isn't listed or counted; of equally rare terms the alphabetically
first (in a phrase: the one further left) counts as rarer, which changes no result; empty tables give empty results or no hits;
texts are read whole; other columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import shared_table

WINDOW = 13
MISSING_ONE_IN = 5              # a proximity match may lack one in so many of a tile's distinct terms
RARE_TERMS = 3                  # rare terms that a stretch must hold to be checked (fewer if the tile needs fewer)
BROADCAST_TERMS = 1 << 18       # a term table of at most this many rows is copied to every task, else shuffled
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, case kept; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table for broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


@dataclass
class Items:
    """Test items as (item, item_id, n, p, term): one row per word position."""
    terms: DataFrame
    vocabulary: DataFrame
    n_terms: int


def item_terms(benchmark: DataFrame) -> Items:
    """Number the item rows and their words, and list the distinct terms."""
    listed = (benchmark.select(F.monotonically_increasing_id().alias("item"),
                               F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
              .select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))
              .select("item", "item_id", "n", "p", lowered(F.col("word")).alias("term")))
    terms = shared_table(listed, "items")
    vocabulary = shared_table(terms.select("term").distinct(), "vocabulary")
    return Items(terms, vocabulary, vocabulary.count())


def build_index(docs: DataFrame, items: Items) -> DataFrame:
    """(term, row, pos, doc_id, n_words): the postings of the items' terms, and a head (pos -1) per document."""
    head = F.array(F.lit(None).cast("string"))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))
            .select("row", "doc_id", F.size("w").alias("n_words"),
                    F.posexplode(F.concat(head, F.col("w"))).alias("at", "word"))
            .select("row", (F.col("at") - 1).alias("pos"), F.when(F.col("at") == 0, F.col("doc_id")).alias("doc_id"),
                    F.when(F.col("at") == 0, F.col("n_words")).alias("n_words"),
                    lowered(F.col("word")).alias("term")))
    known = items.vocabulary.select(F.col("term").alias("known"))
    kept = rows.join(sized(known, items.n_terms), rows["term"] == known["known"], "left").where(
        "known is not null or pos = -1")
    return shared_table(kept.select("term", "row", "pos", "doc_id", "n_words").sortWithinPartitions("term"), "index")


def rare_positions(index: DataFrame, items: Items, window: int) -> DataFrame:
    """(term, item, n, p): for each window, the positions of its two rarest terms; windows with an absent term have none."""
    counts = index.where("pos >= 0").groupBy("term").agg(F.count("*").alias("df"))
    counted = items.terms.join(counts, "term", "left").select("item", "n", "p", "term", F.coalesce("df", F.lit(0)).alias("df"))
    # every window a position lies in; a shorter item is one window
    last = F.greatest(F.col("n") - window, F.lit(0))
    covered = counted.select("*", F.explode(F.sequence(F.greatest(F.col("p") - window + 1, F.lit(0)),
                                                       F.least(F.col("p"), last))).alias("start"))
    by = W.partitionBy("item", "start")
    ranked = covered.select("*", F.min("df").over(by).alias("least"),
                            F.row_number().over(by.orderBy("df", "p")).alias("rank"))
    return ranked.where("rank <= 2 and least > 0").select("term", "item", "n", "p").distinct()


def alignments(index: DataFrame, rare: DataFrame, n_rare: int) -> DataFrame:
    """(row, item, shift): documents and items that agree in two rare terms at the same distance."""
    return (index.where("pos >= 0").select("term", "row", "pos").join(sized(rare, n_rare), "term")
            .groupBy("row", "item", (F.col("pos") - F.col("p")).alias("shift"))
            .agg(F.count("*").alias("hits"), F.first("n").alias("n"))
            .where(F.col("hits") >= F.least(F.lit(2), F.col("n")))
            .select("row", "item", "shift"))


def postings_of(index: DataFrame, found: DataFrame) -> DataFrame:
    """(row, pos, term) of the documents in ``found``; of all documents if their ids are too many to be copied to every task."""
    rows = found.select("row").distinct()
    postings = index.where("pos >= 0").select("row", "pos", "term")
    n_rows = rows.count()
    return postings.join(F.broadcast(rows), "row", "left_semi") if n_rows <= BROADCAST_TERMS else postings


def phrase_matches(index: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """(row, item, item_id, first, last): word ranges of documents that hold one or more whole windows."""
    rare = shared_table(rare_positions(index, items, window), "rare")
    found = shared_table(alignments(index, rare, rare.count()), "alignments")
    probes = found.join(items.terms, "item").select(
        "row", (F.col("shift") + F.col("p")).alias("pos"), "term", "item", "item_id", "n", "p", "shift")
    # the probes are the small side: they are hashed, the postings only stream past
    matched = postings_of(index, found).join(probes.where("pos >= 0").hint("shuffle_hash"), ["row", "pos", "term"])
    line = W.partitionBy("row", "item", "shift").orderBy("p")
    runs = (matched.withColumn("run", F.col("p") - F.row_number().over(line))
            .groupBy("row", "item", "item_id", "shift", "run", "n")
            .agg(F.min("pos").alias("first"), F.max("pos").alias("last")))
    return (runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n")))
            .select("row", "item", "item_id", "first", "last"))


def tile_terms(index: DataFrame, items: Items, window: int, one_in: int) -> DataFrame:
    """(item, item_id, start, term, least, rank, rarest): the distinct terms of each tile, the rarest first.

    least: terms that a match holds; rarest: how many of the tile's first terms are looked up.
    Tiles with fewer known terms than ``least`` are left out.
    """
    counts = index.where("pos >= 0").groupBy("term").agg(F.count("*").alias("df"))
    last = F.greatest(F.col("n") - window, F.lit(0))
    tile = F.least(F.col("p") - F.col("p") % window, last)
    terms = (items.terms.select("item", "item_id", "term", F.explode(F.array_distinct(F.array(
        tile, F.when(F.col("p") >= last, last).otherwise(tile)))).alias("start")).distinct()
        .join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    by = W.partitionBy("item", "start")
    size = F.count("*").over(by)
    return (terms.select("item", "item_id", "start", "term", (size - F.floor(size / one_in)).alias("least"),
                         F.floor(size / one_in).alias("missing"), F.sum((F.col("df") > 0).cast("int")).over(by).alias("known"),
                         F.row_number().over(by.orderBy("df", "term")).alias("rank"))
            .where("known >= least")
            .select("item", "item_id", "start", "term", "least", "rank",
                    (F.col("missing") + F.least(F.lit(RARE_TERMS), F.col("least"))).alias("rarest")))


def _stretches(pos: Column, span: int) -> Column:
    """Numbers of the overlapping stretches of 2 * span words that hold a position; every span words lie in one of them."""
    at = F.floor(pos / span)
    return F.filter(F.array(at - 1, at), lambda b: b >= 0)


def proximity_matches(index: DataFrame, items: Items, window: int = WINDOW, one_in: int = MISSING_ONE_IN) -> DataFrame:
    """(row, item, item_id, start, first, n_near): tiles of items whose terms lie close together in a document.

    n_near: the most distinct terms of the tile that ``2 * window`` consecutive words hold, at least
    all but one in ``one_in``; first: where the first such words begin. Windows have at most 62 words.
    """
    if window > 62:
        raise ValueError("a proximity window has at most 62 words")
    span = 2 * window
    terms = shared_table(tile_terms(index, items, window, one_in), "tiles")
    rare = terms.where("rank <= rarest").select(
        "term", "item", "start", F.expr("shiftleft(1L, rank)").alias("mark"),
        F.least(F.lit(RARE_TERMS), F.col("least")).alias("needed"))
    found = shared_table(
        index.where("pos >= 0").select("term", "row", "pos").join(sized(rare, rare.count()), "term")
        .select("row", "item", "start", "mark", "needed", F.explode(_stretches(F.col("pos"), span)).alias("stretch"))
        .groupBy("row", "item", "start", "stretch").agg(F.bit_or("mark").alias("marks"), F.first("needed").alias("needed"))
        .where(F.bit_count("marks") >= F.col("needed")).select("row", "item", "start", "stretch"), "stretches")
    wanted = found.join(sized(terms, terms.count()), ["item", "start"]).select(
        "row", "stretch", "term", "item", "item_id", "start", "least")
    near = postings_of(index, found).select("row", "pos", "term", F.explode(_stretches(F.col("pos"), span)).alias("stretch"))
    # at most 2 * span positions of a stretch for each tile
    at = (near.join(wanted.hint("shuffle_hash"), ["row", "stretch", "term"])
          .groupBy("row", "item", "item_id", "start", "stretch")
          .agg(F.first("least").alias("least"), F.collect_list(F.struct("pos", "term")).alias("at")))

    def terms_from(begin: Column) -> Column:
        inside = F.filter("at", lambda x: (x["pos"] >= begin["pos"]) & (x["pos"] < begin["pos"] + span))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["term"]))).alias("n_near"),
                        (-begin["pos"]).alias("back"))

    best = at.select("row", "item", "item_id", "start", "least", F.array_max(F.transform("at", terms_from)).alias("best"))
    return (best.where("best.n_near >= least").groupBy("row", "item", "item_id", "start").agg(F.max("best").alias("best"))
            .select("row", "item", "item_id", "start", (-F.col("best.back")).alias("first"), "best.n_near"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    With ``proximity`` also n_near_items, the number of items with a proximity match.
    """
    items = item_terms(benchmark)
    index = build_index(docs, items)
    matches = shared_table(phrase_matches(index, items, window), "matches")
    hit = (matches.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
           .groupBy("row").agg(F.count("*").alias("n_hit")))
    listed = (matches.groupBy("row").agg(F.collect_set("item_id").alias("ids"))
              .select("row", F.size("ids").cast("long").alias("n_items"),
                      F.concat_ws(",", F.array_sort("ids")).alias("ids")))
    heads = index.where("pos = -1").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found, more = heads.join(hit, "row", "left").join(listed, "row", "left"), []
    if proximity:
        near = proximity_matches(index, items, window).groupBy("row").agg(F.countDistinct("item_id").alias("n_near_items"))
        found, more = found.join(near, "row", "left"), [F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")]
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *more)


def contamination_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for `contamination` with proximity over documents and benchmark."""
    span = 2 * window
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n,
         array_to_string(list_slice(w, s, s + least(len(w), {window}) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT g.doc_id, g.s, g.n, windows.item_id
  FROM (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)) g
  JOIN windows ON g.phrase = windows.phrase AND g.n = windows.n),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
         FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
tiles AS (
  SELECT item, item_id, w, unnest(list_distinct(list_append(range(0, greatest(len(w) - {window}, 0) + 1, {window}),
                                                            greatest(len(w) - {window}, 0)))) AS start
  FROM (SELECT row_number() OVER () AS item, item_id, w FROM b WHERE len(w) > 0)),
terms AS (SELECT DISTINCT item, item_id, start, unnest(list_slice(w, start + 1, start + {window})) AS term FROM tiles),
needs AS (SELECT item, start, count(*) - count(*) // {MISSING_ONE_IN} AS least FROM terms GROUP BY item, start),
postings AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM d),
rough AS (
  SELECT doc_id, item, start, stretch
  FROM (SELECT doc_id, item, start, term, unnest([pos // {span} - 1, pos // {span}]) AS stretch
        FROM postings JOIN terms USING (term)) JOIN needs USING (item, start)
  GROUP BY doc_id, item, start, stretch, least HAVING count(DISTINCT term) >= least),
inside AS (
  SELECT r.doc_id, r.item, r.start, r.stretch, t.item_id, t.term, p.pos
  FROM rough r JOIN terms t USING (item, start)
  JOIN postings p ON p.doc_id = r.doc_id AND p.term = t.term AND p.pos // {span} IN (r.stretch, r.stretch + 1)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near_items
  FROM (SELECT x.doc_id, x.item, x.start, x.item_id
        FROM inside x JOIN inside y USING (doc_id, item, start, stretch)
        JOIN needs USING (item, start)
        WHERE y.pos BETWEEN x.pos AND x.pos + {span - 1}
        GROUP BY x.doc_id, x.item, x.start, x.item_id, x.stretch, x.pos, least HAVING count(DISTINCT y.term) >= least)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""
