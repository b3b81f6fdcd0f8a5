"""Corpus queries over `documents` (code-file stand-in), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import curate, examples, stats
from corpusloom.plans import sqlgen as S
from corpusloom.plans.bindings import CODE_DOCUMENTS_SQL, CODE_FILES_SQL, code_documents, code_files
from corpusloom.plans.registry import register
from corpusloom.session import read_table

FP, FD = R.FIXTURE_CATEGORY_PATTERNS, R.FIXTURE_DEFAULT_CATEGORY
_CAT_SQL = S.categorize_scored("content", FP, FD)
_CTX_SQL = S.categorize_context("content", "file_path", "repo", FP, FD, R.FIXTURE_CONTEXT_RULES)

# F1 + O2 as a DuckDB CTE prefix: files -> gated -> deduped (first doc_id per hash)
_DEDUPED = f"""WITH files AS ({CODE_FILES_SQL}),
gated AS (SELECT * FROM files WHERE length(content) BETWEEN {R.MIN_CODE_LENGTH} AND {R.MAX_CODE_LENGTH}),
deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {S.hash16('content')} AS content_hash,
  row_number() OVER (PARTITION BY {S.hash16('content')} ORDER BY doc_id) AS rn FROM gated) WHERE rn = 1)"""


def _gated(spark, sf):
    return code_files(spark, sf).select("doc_id", "content").filter(T.length_between("content"))


@register("category_distribution", f"""{_DEDUPED}
SELECT category, count(*) AS n FROM (SELECT {_CAT_SQL} AS category FROM deduped) GROUP BY category""")
def category_distribution(spark, sf):
    """Flagship: F1 -> O2 -> X1 -> A1 (count per category)."""
    # equal texts have equal categories: the category's number goes through the dedupe shuffle, the text doesn't
    names = F.array(*[F.lit(c) for c, _ in FP], F.lit(FD))
    number = F.array_position(names, T.categorize_scored("content", FP, FD))
    d = curate.first_ids(_gated(spark, sf), curate.text_key("content"), "doc_id", number=number)
    return d.groupBy("number").agg(F.count(F.lit(1)).alias("n")).select(
        F.element_at(names, F.col("number").cast("int")).alias("category"), "n")


@register("length_gate", f"""WITH files AS ({CODE_FILES_SQL})
SELECT doc_id, CAST(length(content) AS BIGINT) AS n_chars FROM files
WHERE length(content) BETWEEN {R.MIN_CODE_LENGTH} AND {R.MAX_CODE_LENGTH}""")
def length_gate(spark, sf):
    f = code_files(spark, sf)
    return f.filter(T.length_between("content")).select("doc_id", F.length("content").cast("long").alias("n_chars"))


@register("stripped_length_gate", """SELECT doc_id,
  CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS stripped_len FROM documents
WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100""")
def stripped_length_gate(spark, sf):
    d = read_table(spark, sf, "documents")
    return (d.select("doc_id", T.stripped_length("text").cast("long").alias("stripped_len"))
            .filter(F.col("stripped_len") >= 100))


@register("exact_dedupe", f"""{_DEDUPED} SELECT doc_id, content_hash FROM deduped""")
def exact_dedupe(spark, sf):
    d = curate.first_ids(_gated(spark, sf), curate.text_key("content"), "doc_id")
    return d.select("doc_id", F.lower(F.hex(F.substring("_key", 1, 8))).alias("content_hash"))


@register("content_hash", f"SELECT doc_id, {S.hash16('text')} AS content_hash FROM documents")
def content_hash(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.hash16("text").alias("content_hash"))


@register("categorize_scored", f"WITH files AS ({CODE_FILES_SQL}) SELECT doc_id, {_CAT_SQL} AS category FROM files")
def categorize_scored(spark, sf):
    return code_files(spark, sf).select("doc_id", T.categorize_scored("content", FP, FD).alias("category"))


@register("categorize_context", f"WITH files AS ({CODE_FILES_SQL}) SELECT doc_id, {_CTX_SQL} AS category FROM files")
def categorize_context(spark, sf):
    c = T.categorize_context("content", "file_path", "repo", FP, FD, R.FIXTURE_CONTEXT_RULES)
    return code_files(spark, sf).select("doc_id", c.alias("category"))


@register("categorize_first", f"""SELECT doc_id,
  {S.first_match('text', R.FIXTURE_FIRST_MATCH_RULES, FD)} AS category FROM documents""")
def categorize_first(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.categorize_first("text", R.FIXTURE_FIRST_MATCH_RULES, FD).alias("category"))


_CAPWORD = r"([A-Z][a-z]+)"


@register("extract_symbols", f"""WITH documents AS ({CODE_DOCUMENTS_SQL.replace("FROM documents", "FROM main.documents")}) SELECT doc_id,
  CAST(len(regexp_extract_all(text, '(?i){R.FUNCTION_PATTERN}', 1)) AS INTEGER) AS n_functions,
  CAST(len(regexp_extract_all(text, '(?i){R.CLASS_PATTERN}', 1)) AS INTEGER) AS n_classes,
  CAST(len(regexp_extract_all(text, '(?i){R.IMPORT_PATTERN}', 0)) AS INTEGER) AS n_imports,
  array_to_string(regexp_extract_all(text, '(?i){_CAPWORD}', 1), ',') AS cap_words
FROM documents""")
def extract_symbols(spark, sf):
    d = code_documents(spark, sf)
    return d.select("doc_id", F.size(T.extract_functions("text")).alias("n_functions"),
                    F.size(T.extract_classes("text")).alias("n_classes"),
                    F.size(T.extract_imports("text")).alias("n_imports"),
                    F.array_join(T.extract_all("text", _CAPWORD, 1), ",").alias("cap_words"))


@register("lines_of_code", f"SELECT doc_id, CAST({S.lines_of_code('text')} AS INTEGER) AS loc FROM documents")
def lines_of_code(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.lines_of_code("text").alias("loc"))


@register("complexity_score", f"""SELECT doc_id,
  CAST({S.indicator_count('text', R.COMPLEXITY_INDICATORS)} AS INTEGER) AS indicators,
  round({S.complexity_score('text', R.COMPLEXITY_INDICATORS)}, 9) AS complexity_score FROM documents""")
def complexity_score(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.complexity_indicator_count("text").alias("indicators"),
                    F.round(T.complexity_score("text"), 9).alias("complexity_score"))


@register("truncate_chars", "SELECT doc_id, substr(text, 1, 1000) || '...' AS snippet FROM documents")
def truncate_chars(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.truncate_chars("text", 1000).alias("snippet"))


@register("collapse_blank_lines", f"""SELECT doc_id,
  regexp_replace(text, '{R.BLANK_LINES_PATTERN}', chr(10) || chr(10), 'g') AS cleaned FROM documents""")
def collapse_blank_lines(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.collapse_blank_lines("text").alias("cleaned"))


def _tag_sql(expr, rules):
    out = expr
    for pat, tag in rules:
        out = f"regexp_replace({out}, {S.lit(pat)}, {S.lit(tag + chr(92) + '1')}, 'g')"
    return out


@register("tag_text", f"SELECT doc_id, {_tag_sql('text', R.FIXTURE_TAG_RULES)} AS tagged FROM documents")
def tag_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.tag_text("text", R.FIXTURE_TAG_RULES).alias("tagged"))


@register("truncate_lines", f"""WITH src AS (SELECT doc_id, text FROM documents),
long AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM src WHERE length(text) > 3000),
lines AS (SELECT doc_id, unnest(arr) AS s, unnest(range(1, len(arr) + 1)) AS i FROM long),
acc AS (SELECT doc_id, s, i, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM lines),
cut AS (SELECT doc_id, min(i) AS stop_at FROM acc WHERE used + length(s) > 2900 GROUP BY doc_id),
kept AS (SELECT a.doc_id, string_agg(a.s, chr(10) ORDER BY a.i) AS body FROM acc a JOIN cut c USING (doc_id)
         WHERE a.i < c.stop_at GROUP BY a.doc_id),
res AS (SELECT c.doc_id, CASE WHEN k.body IS NULL THEN '    # ... (truncated)'
          ELSE k.body || chr(10) || '    # ... (truncated)' END AS out FROM cut c LEFT JOIN kept k USING (doc_id))
SELECT s.doc_id, CAST(length(coalesce(r.out, s.text)) AS INTEGER) AS out_len,
       {S.hash16('coalesce(r.out, s.text)')} AS out_hash
FROM src s LEFT JOIN res r USING (doc_id)""")
def truncate_lines(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", T.truncate_lines("text", 3000).alias("out"))
    return d.select("doc_id", F.length("out").alias("out_len"), T.hash16("out").alias("out_hash"))


@register("top_words", """SELECT word, count(*) AS n FROM
  (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def top_words(spark, sf):
    d = read_table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
                                                  .alias("word"))
    return stats.top_k_counts(d, "word", 10)


def _top_symbols_sql(pattern):
    return f"""SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(
  regexp_extract_all(text, '(?i){pattern}', 1), lambda x: x <> '')) AS name FROM ({CODE_DOCUMENTS_SQL}))
GROUP BY name ORDER BY n DESC, name LIMIT 10"""


@register("top_functions", _top_symbols_sql(R.FUNCTION_PATTERN))
def top_functions(spark, sf):
    """A4: the ten most frequent function names."""
    return stats.top_k_counts(code_documents(spark, sf).select(F.explode(T.extract_functions("text")).alias("name")),
                              "name", 10)


@register("top_classes", _top_symbols_sql(R.CLASS_PATTERN))
def top_classes(spark, sf):
    """A4: the ten most frequent class names."""
    return stats.top_k_counts(code_documents(spark, sf).select(F.explode(T.extract_classes("text")).alias("name")),
                              "name", 10)


@register("loc_mean_median", f"""{_DEDUPED},
l AS (SELECT CAST({S.lines_of_code('content')} AS BIGINT) AS loc FROM deduped),
o AS (SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS idx, count(*) OVER () AS n FROM l)
SELECT round((SELECT avg(loc) FROM l), 9) AS mean_loc, (SELECT loc FROM o WHERE idx = n // 2) AS median_loc""")
def loc_mean_median(spark, sf):
    d = curate.first_ids(_gated(spark, sf), curate.text_key("content"), "doc_id",
                         loc=T.lines_of_code("content").cast("long"))
    return stats.mean_upper_median(d, "loc")


@register("duplicate_count", f"""SELECT CAST(count(*) - count(DISTINCT {S.hash16('text')}) AS BIGINT) AS duplicate_count
FROM documents""")
def duplicate_count(spark, sf):
    d = read_table(spark, sf, "documents").select(curate.text_key("text").alias("h"))
    return stats.duplicate_count(d, "h")


@register("head_lines_per_source", f"""SELECT doc_id,
  CAST(len(string_split(text, chr(10))[1:50]) AS INTEGER) AS n_lines,
  {S.hash16("array_to_string(string_split(text, chr(10))[1:50], chr(10))")} AS head_hash FROM documents""")
def head_lines_per_source(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.slice(F.split("text", "\n", -1), 1, 50).alias("head"))
    return d.select("doc_id", F.size("head").alias("n_lines"), T.hash16(F.array_join("head", "\n")).alias("head_hash"))


_REL_KW, _REL_IMP = r"(zusammen|pour|porque)", r"(import|from)"


@register("relevance_filter", f"""SELECT doc_id FROM documents
WHERE regexp_matches(text, '(?i){_REL_KW}') OR regexp_matches(text, '(?i){_REL_IMP}')""")
def relevance_filter(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.filter(F.col("text").rlike("(?i)" + _REL_KW) | F.col("text").rlike("(?i)" + _REL_IMP)).select("doc_id")


def _routes_sql(expr, routes):
    arms = " UNION ALL ".join(
        f"SELECT doc_id, {S.lit(cat)} AS category FROM documents WHERE {S.any_contains(expr, needles)}"
        for cat, needles in routes)
    return f"SELECT DISTINCT doc_id, category FROM ({arms})"


@register("multi_label_route", _routes_sql("text", R.FIXTURE_TEXT_ROUTES))
def multi_label_route(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.explode(T.route_labels("text", R.FIXTURE_TEXT_ROUTES)).alias("category"))


@register("complexity_level", f"""WITH files AS ({CODE_FILES_SQL}),
s AS (SELECT doc_id, {_CAT_SQL} AS category, {S.complexity_score('content', R.COMPLEXITY_INDICATORS)} AS score
      FROM files)
SELECT doc_id, {S.complexity_level("CASE category WHEN 'english_prose' THEN 3 WHEN 'german_prose' THEN 4 ELSE 5 END",
                                   'score')} AS complexity FROM s""")
def complexity_level(spark, sf):
    f = code_files(spark, sf)
    steps = F.size(examples.expand_templates(T.categorize_scored("content", FP, FD), R.FIXTURE_STEP_TEMPLATES))
    return f.select("doc_id", T.complexity_level(steps, T.complexity_score("content")).alias("complexity"))
