"""Vocabulary and tokenisation queries over `documents`."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusloom.functions import text as T

from corpusloom.operators import vocab as V
from corpusloom.plans import sqlgen as S
from corpusloom.plans.registry import register
from corpusloom.session import read_table

_SPECIAL_SQL = "|".join(re.escape(t) for t in V.SPECIAL_TOKENS)
_PRE_SQL = f"'{_SPECIAL_SQL}|" + "\\s+|[^\\pL\\pN_\\s<>/.\\-:]+|[\\pL\\pN_<>/.\\-:]+'"
# the byte-level cut; pieces hold either white space only or none, so no lookahead is needed
_CUT = S.lit(r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN+|[^\s\pL\pN]+|\s+")
_SPECIALS = ", ".join(S.lit(t) for t in V.SPECIAL_TOKENS)
_PIECES_SQL = (f"flatten(list_transform(regexp_extract_all(strip_accents(text), {_PRE_SQL}), "
               f"lambda p: CASE WHEN p IN ({_SPECIALS}) THEN [p] ELSE regexp_extract_all(p, {_CUT}) END))")
_WORDS_SQL = f"""words AS (SELECT w AS word, count(*) AS freq FROM
  (SELECT unnest(regexp_extract_all(strip_accents(text), {_PRE_SQL})) AS w FROM documents)
  WHERE NOT regexp_matches(w, '^\\s+$') GROUP BY w HAVING count(*) >= 2)"""


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("strip_accents", f"SELECT doc_id, {S.hash16('strip_accents(text)')} AS norm_hash, "
                           "CAST(length(strip_accents(text)) AS INTEGER) AS norm_len FROM documents")
def strip_accents(spark, sf):
    """K1: NFD + strip accents (Arrow UDF with unicodedata)."""
    d = _docs(spark, sf).select("doc_id", V.strip_accents("text").alias("t"))
    return d.select("doc_id", T.hash16("t").alias("norm_hash"), F.length("t").alias("norm_len"))


@register("pretokens", f"""SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, {S.hash16("array_to_string(p, chr(1))")}
  AS pieces_hash FROM (SELECT doc_id, {_PIECES_SQL} AS p FROM documents)""")
def pretokens(spark, sf):
    """K1 -> K2: normalise, pre-tokenise (delimiters kept as pieces, special tokens atomic), byte-level cut."""
    d = V.normalized(_docs(spark, sf), "text").select("doc_id", V.byte_level_pieces(V.pretokens(F.col("text"))).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_pieces"), T.hash16(F.array_join("p", "\x01")).alias("pieces_hash"))


@register("word_histogram", f"WITH {_WORDS_SQL} SELECT word, freq FROM words")
def word_histogram(spark, sf):
    """K3: word counts with min_frequency 2."""
    return V.word_histogram(_docs(spark, sf), "text")


@register("alphabet_top", f"""WITH {_WORDS_SQL}
SELECT ch, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM words)
GROUP BY ch ORDER BY n DESC, ch LIMIT 1000""")
def alphabet_top(spark, sf):
    """K4: the 1000 commonest characters (weighted by word frequency)."""
    return V.alphabet(V.word_histogram(_docs(spark, sf), "text")).select("ch", F.col("n").cast("long").alias("n"))


@register("bpe_first_pairs", f"""WITH {_WORDS_SQL},
s AS (SELECT string_split(word, '') AS sym, freq FROM words WHERE length(word) > 1),
p AS (SELECT sym[i] AS a, sym[i + 1] AS b, freq FROM (SELECT sym, freq, unnest(range(1, len(sym))) AS i FROM s))
SELECT a, b, CAST(sum(freq) AS BIGINT) AS n FROM p GROUP BY a, b ORDER BY n DESC, a, b LIMIT 20""")
def bpe_first_pairs(spark, sf):
    """K5 round 1: the 20 commonest adjacent pairs (ties lexicographic)."""
    words = V.word_histogram(_docs(spark, sf), "text")
    sym = words.select(F.split("word", "").alias("sym"), "freq").filter(F.size("sym") > 1)
    return (V.pair_counts(sym).orderBy(F.col("n").desc(), "a", "b").limit(20)
            .select("a", "b", F.col("n").cast("long").alias("n")))


FIRST_MERGES = 3
_SEP = "chr(2)"


def _first_merges_sql():
    """The exact merges of the first rounds, unrolled: symbols are wrapped in separators, a merge is a replacement."""
    ctes = [_WORDS_SQL, f"""w0 AS (SELECT array_to_string(list_transform(string_split(word, ''), lambda c: {_SEP} || c || {_SEP}), '')
  AS s, freq FROM words)"""]
    for r in range(FIRST_MERGES):
        ctes.append(f"""l{r} AS (SELECT string_split(trim(s, {_SEP}), {_SEP} || {_SEP}) AS sym, freq FROM w{r}),
m{r} AS (SELECT a, b, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT sym[i] AS a, sym[i + 1] AS b, freq FROM
  (SELECT sym, freq, unnest(range(1, len(sym))) AS i FROM l{r})) GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1),
w{r + 1} AS (SELECT replace(s, {_SEP} || a || {_SEP} || {_SEP} || b || {_SEP}, {_SEP} || a || b || {_SEP}) AS s, freq
  FROM w{r}, m{r})""")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(
        f"SELECT CAST({r + 1} AS INTEGER) AS merge_rank, a, b, n FROM m{r}" for r in range(FIRST_MERGES))


@register("bpe_first_merges", _first_merges_sql())
def bpe_first_merges(spark, sf):
    """K5 over characters: the merges of the first rounds as a table (rank, a, b, count)."""
    merges = V.bpe_train(V.word_histogram(_docs(spark, sf), "text"), FIRST_MERGES, byte_level=False)
    return spark.createDataFrame([(i + 1, a, b, n) for i, (a, b, n) in enumerate(merges)],
                                 "merge_rank int, a string, b string, n long")


_TRAINED: dict[tuple, V.Tokenizer] = {}


def tokenizer(spark, sf) -> V.Tokenizer:
    """The tokenizer of a folder's documents, trained once per session and state of the files."""
    state = _docs(spark, sf).select("_metadata.file_path", "_metadata.file_modification_time").distinct().agg(
        F.count("*"), F.max("file_modification_time")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _TRAINED:
        _TRAINED[key] = V.train_tokenizer(_docs(spark, sf), "text")
    return _TRAINED[key]


@register("bpe_merges")
def bpe_merges(spark, sf):
    """K5: the vocabulary of up to 8,192 tokens: special tokens, alphabet, merges."""
    return V.vocabulary_table(spark, tokenizer(spark, sf))


def _encoded(spark, sf):
    return V.encode(_docs(spark, sf).select("doc_id", "lang", "text"), "text", tokenizer(spark, sf))


@register("bpe_encode")
def bpe_encode(spark, sf):
    """K6: token ids of every document, and whether they decode to the normalised text."""
    t = tokenizer(spark, sf)
    e = _encoded(spark, sf)
    return e.select("doc_id", F.size("ids").alias("n_tokens"), F.hex(F.xxhash64("ids")).alias("ids_xxh64"),
                    (V.decode(F.col("ids"), t) == F.col("text")).alias("decoded"))


@register("chars_per_token_bpe")
def chars_per_token_bpe(spark, sf):
    """A17 / K7 over encoded tokens: characters per token by language and overall."""
    d = _encoded(spark, sf).select("lang", F.size("ids").alias("n_tok"), F.length("text").alias("n_chars"))
    g = d.groupingSets([["lang"], []], "lang").agg(F.sum("n_tok").cast("long").alias("tokens"),
                                                   F.sum("n_chars").cast("long").alias("chars"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("category"), "tokens", "chars",
                    F.round(F.col("chars") / F.col("tokens"), 6).alias("chars_per_token"))


@register("chars_per_token", f"""SELECT coalesce(lang, 'all') AS category, CAST(sum(n_tok) AS BIGINT) AS tokens,
  CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / sum(n_tok), 6) AS chars_per_token FROM
  (SELECT lang, len(regexp_extract_all(text, {_PRE_SQL})) AS n_tok, length(text) AS n_chars FROM documents)
GROUP BY GROUPING SETS ((lang), ())""")
def chars_per_token(spark, sf):
    """Tokens, characters and characters per token by category and overall."""
    d = _docs(spark, sf).select("lang", V.count_pretokens(F.col("text")).alias("n_tok"),
                                F.length("text").alias("n_chars"))
    g = d.groupingSets([["lang"], []], "lang").agg(F.sum("n_tok").cast("long").alias("tokens"),
                                                   F.sum("n_chars").cast("long").alias("chars"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("category"), "tokens", "chars",
                    F.round(F.col("chars") / F.col("tokens"), 6).alias("chars_per_token"))


@register("pad_mask")
def pad_mask(spark, sf):
    """Token ids cut/padded to 512 with an attention mask; labels = ids. Beside them how many are attended, padding, and the ids' sum."""
    ids, mask = V.pad_truncate(F.col("ids"))
    x = _encoded(spark, sf).select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    return x.select("doc_id", "input_ids", "attention_mask", F.col("input_ids").alias("labels"), attended.alias("attended"),
                    (F.size("input_ids") - attended).alias("padding"),
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_checksum"))
