"""Page, conversation and typed-record queries over `pages`, `conversations`
and `events` (H1-H5, F3, F5, F6, J6, J10, U3, M3, M5-M7, A18, A19, E8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dispatch as D
from corpusloom.operators import pages as P
from corpusloom.plans import sqlgen as S
from corpusloom.plans.registry import register
from corpusloom.session import read_table


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


_MAIN_SQL = ("coalesce(nullif(regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1), ''), "
             "nullif(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), ''), "
             "nullif(regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1), ''))")


@register("page_main_text_regex", f"""SELECT page_id, trim(regexp_replace(regexp_replace({_MAIN_SQL},
  '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS main_text FROM pages""")
def page_main_text_regex(spark, sf):
    """H1 (regex form): first of main/article/body, tags to spaces, whitespace collapsed."""
    return _pages(spark, sf).select("page_id", P.strip_tags(P.first_section(F.col("html"))).alias("main_text"))


@register("page_main_text", f"""SELECT page_id, {S.html_text(f"regexp_extract({S.html_without('html', ())}, '(?s)<article[^>]*>(.*?)(</article>|$)', 1)")}
  AS main_text FROM pages""")
def page_main_text(spark, sf):
    """H1 (parser form, Arrow UDF): text pieces of the first of main/article/body."""
    return _pages(spark, sf).select("page_id", P.main_text_parsed("html").alias("main_text"))


@register("page_all_text", f"""SELECT page_id, {S.html_text(S.html_without('html', P.DROP_TAGS))} AS text FROM pages""")
def page_all_text(spark, sf):
    """H2 (parser form): all text without script/style/nav."""
    return _pages(spark, sf).select("page_id", P.all_text_parsed("html").alias("text"))


@register("page_title", """SELECT page_id, CASE WHEN trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) = ''
  THEN 'No title' ELSE trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) END AS title FROM pages""")
def page_title(spark, sf):
    return _pages(spark, sf).select("page_id", P.title(F.col("html")).alias("title"))


@register("page_select", f"""SELECT page_id, {S.html_elements('html', 'p')} AS content, {S.html_elements('html', 'h1')}
  AS headings, {S.html_elements('html', 'li')} AS items FROM pages""")
def page_select(spark, sf):
    """H3: named selectors -> one text per matched element, in one parser pass."""
    sel = P.select_udf({"content": ["p"], "headings": ["h1", "h2", "h3"], "items": ["li"]})
    return _pages(spark, sf).select("page_id", sel("html").alias("s")).select(
        "page_id", *[F.col("s")[k].alias(k) for k in ("content", "headings", "items")])


# the pages hold no code: every hundredth gets some, nested and with markup inside
_KEYWORDS = "(^| )(the|que|und)( |$)"
_CODE = "<pre>a = 1 <b>+</b> <code>b</code></pre><p>then <code>x &lt; y</code></p>"
_WITH_CODE = f"CASE WHEN page_id % 100 = 0 THEN replace(html, '</article>', '{_CODE}</article>') ELSE html END"


@register("page_split", f"""SELECT page_id, {S.html_text(
    "regexp_replace(regexp_replace(h, '(?s)<pre>.*?</pre>', ' ', 'g'), '(?s)<code>.*?</code>', ' ', 'g')")} AS text,
  CASE WHEN page_id % 100 = 0 AND contains(html, '</article>') THEN ['a = 1 + b', 'x < y'] ELSE []::VARCHAR[] END AS code,
  list_filter(list_transform(range(2, len(els) + 1), lambda i: CASE WHEN tags[i] = 'p' AND regexp_matches(els[i], '{_KEYWORDS}')
    THEN els[i - 1] END), lambda x: x IS NOT NULL AND x <> '') AS natural_language_description
FROM (SELECT *, {S.html_element_texts('h', 'h1|p')} AS els, regexp_extract_all(h, '<(h1|p)>', 1) AS tags
  FROM (SELECT page_id, html, {S.html_without(_WITH_CODE, ('script', 'style'))} AS h FROM pages))""")
def page_split(spark, sf):
    """H4: code/text split, and what stands before paragraphs with a keyword."""
    p = _pages(spark, sf).select("page_id", F.expr(_WITH_CODE).alias("html"))
    return p.select("page_id", P.split_code_text("html").alias("c"), P.tutorial_context(["p"], _KEYWORDS)("html").alias("d")).select(
        "page_id", "c.text", "c.code", F.col("d").alias("natural_language_description"))


# no page holds such a block: every third gets one of two lines
_WITH_PRE = ("CASE WHEN page_id % 3 = 0 THEN replace(html, '</h1>', concat('</h1><pre class=\"rfc-text\">RFC ', "
             "CAST(page_id AS STRING), chr(10), 'Section 1</pre>')) ELSE html END")


@register("pre_block", f"""SELECT page_id, regexp_extract({_WITH_PRE.replace('STRING', 'VARCHAR')},
  '(?s)<pre class="rfc-text">(.*?)</pre>', 1) AS pre FROM pages""")
def pre_block(spark, sf):
    return _pages(spark, sf).select("page_id", P.pre_block(F.expr(_WITH_PRE)).alias("pre"))


@register("extension_filter", """SELECT page_id, url FROM pages
WHERE regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '(\\.[^.]+)$', 1) IN ('.com', '.org')""")
def extension_filter(spark, sf):
    """keep names whose extension (here: host suffix) is in a list."""
    p = _pages(spark, sf)
    return p.filter(P.host_extension(F.col("url")).isin(".com", ".org")).select("page_id", "url")


# the URLs name no files: most get one, by page id
_FILE_URL = ("CASE WHEN page_id % 4 < 3 THEN concat(regexp_extract(url, '^[a-z]+://[^/?#]+', 0), '/v1.2/code', "
             "CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JS?x=.md' ELSE '/.txt' END) ELSE url END")
_FILE_URL_SQL = _FILE_URL.replace("STRING", "VARCHAR")
_EXTENSION_SQL = (f"lower(regexp_extract(regexp_extract({_FILE_URL_SQL}, '^[a-z]+://[^/?#]+([^?#]*)', 1), "
                  "'[^/](\\.[^./]+)$', 1))")


@register("path_extension_filter", f"""SELECT page_id, {_EXTENSION_SQL} AS extension FROM pages
WHERE {_EXTENSION_SQL} IN ('.py', '.js', '.txt') ORDER BY page_id LIMIT 100""")
def path_extension_filter(spark, sf):
    """files by the extension of their URL path, at most 100 of them."""
    p = _pages(spark, sf).select("page_id", F.expr(_FILE_URL).alias("url"))
    return P.with_extension(p, "url", (".py", ".js", ".txt"), 100, ["page_id"]).select(
        "page_id", P.path_extension(F.col("url")).alias("extension"))


_SUFFIXES = ["e", "d", "s"]


@register("page_links", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href
  FROM pages),
k AS (SELECT * FROM l WHERE {" OR ".join(f"suffix(href, '{x}')" for x in _SUFFIXES)}),
r AS (SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
  ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' || href END AS link FROM k)
SELECT page_id, link, regexp_extract(link, '([^/]*)$', 1) AS file_name, count(*) AS n FROM r GROUP BY ALL""")
def page_links(spark, sf):
    """links ending in the given suffixes, resolved against the page, with basenames."""
    p = _pages(spark, sf).select("page_id", "url", F.explode(P.links(F.col("html"))).alias("href"))
    cond = F.lit(False)
    for x in _SUFFIXES:
        cond = cond | F.col("href").endswith(x)
    r = p.filter(cond).select("page_id", P.resolve(F.col("href"), F.col("url")).alias("link"))
    return r.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "file_name", P.basename(F.col("link")))


@register("dedupe_urls", """SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY
  regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def dedupe_urls(spark, sf):
    """each URL (without query/fragment) processed once, first page id wins."""
    p = _pages(spark, sf).select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("key"))
    return P.dedupe_by(p, "key", ["page_id"]).select("url", "page_id")


@register("qa_pairs", """SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")
def qa_pairs(spark, sf):
    """A user turn followed by an assistant turn -> one (question, answer) row."""
    c = read_table(spark, sf, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


# --- typed records: events as (data_type, payload) -----------------------------

FIXTURE_DISPATCH = [("click", "sentiment_model"), ("view", "sentiment_model"), ("purchase", "chart_pattern_model"),
                    ("signup", "onchain_model")]
_DMAP_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FIXTURE_DISPATCH) + \
            ") v(data_type, model))"


def _records(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("data_type"),
                                                  F.col("props").alias("payload"), "value")


@register("dispatch_route", f"""SELECT e.event_id, e.event_type AS data_type, m.model FROM events e
JOIN {_DMAP_SQL} m ON m.data_type = e.event_type""")
def dispatch_route(spark, sf):
    return D.route(_records(spark, sf), D.dispatch_map(spark, FIXTURE_DISPATCH)).select("event_id", "data_type", "model")


@register("dispatch_unrouted", f"""SELECT event_id, event_type AS data_type FROM events
WHERE event_type NOT IN (SELECT data_type FROM {_DMAP_SQL})""")
def dispatch_unrouted(spark, sf):
    return D.unrouted(_records(spark, sf), D.dispatch_map(spark, FIXTURE_DISPATCH)).select("event_id", "data_type")


@register("batch_predict_dummy", f"""SELECT e.event_id, m.model, 'Prediction for ' || e.event_type AS prediction
FROM events e JOIN {_DMAP_SQL} m ON m.data_type = e.event_type""")
def batch_predict_dummy(spark, sf):
    r = D.route(_records(spark, sf), D.dispatch_map(spark, FIXTURE_DISPATCH))
    return D.batch_predict(r).select("event_id", "model", "prediction")


@register("group_payloads", """SELECT event_type AS data_type, event_id, props AS payload FROM events
WHERE event_type IS NOT NULL""")
def group_payloads(spark, sf):
    """A18 kept as rows: payloads per data_type in input order (range-sorted, no list per group)."""
    r = _records(spark, sf).filter(F.col("data_type").isNotNull())
    return r.select("data_type", "event_id", "payload").orderBy("data_type", "event_id")


@register("latency_histogram", f"""SELECT m.model, e.event_type AS task_type,
  CASE WHEN value <= 5 THEN 'le_5' WHEN value <= 10 THEN 'le_10' WHEN value <= 25 THEN 'le_25'
       WHEN value <= 50 THEN 'le_50' ELSE 'le_inf' END AS bucket, count(*) AS n
FROM events e JOIN {_DMAP_SQL} m ON m.data_type = e.event_type GROUP BY ALL""")
def latency_histogram(spark, sf):
    """Durations (value as ms) by (model, task type) and bucket."""
    r = D.route(_records(spark, sf), D.dispatch_map(spark, FIXTURE_DISPATCH))
    return r.groupBy("model", F.col("data_type").alias("task_type"), D.latency_bucket(F.col("value")).alias("bucket")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("validate_output", """SELECT event_id,
  TRY_CAST(json_extract_string(trim(regexp_replace(props, '```json\\n|```', '', 'g')), '$.k') AS INTEGER) IS NOT NULL
  AS valid, TRY_CAST(json_extract_string(trim(regexp_replace(props, '```json\\n|```', '', 'g')), '$.k') AS INTEGER) AS k
FROM events""")
def validate_output(spark, sf):
    """M5: strip fences, parse JSON against a schema (here {k: int}); invalid rows flagged."""
    e = read_table(spark, sf, "events")
    parsed = F.from_json(D.strip_fences(F.col("props")), "k INT", {"mode": "PERMISSIVE"})
    return e.select("event_id", parsed["k"].isNotNull().alias("valid"), parsed["k"].alias("k"))


@register("typed_payload", """SELECT event_id, event_type AS data_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""")
def typed_payload(spark, sf):
    """M7: open payload as a VARIANT, field read with variant_get."""
    e = read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("data_type"),
                                               F.parse_json("props").alias("v"))
    return e.select("event_id", "data_type", F.variant_get("v", "$.k", "int").alias("k"))


@register("format_prompt", """SELECT event_id, CASE event_type
  WHEN 'click' THEN 'Decompose the following operation into a sequence of network steps, providing the expected time and resource for each step, and output the result as a JSON array:' || chr(10) || 'Operation: ' || props || chr(10) || 'JSON:'
  WHEN 'view' THEN 'Summarize the following text:' || chr(10) || 'Text: ' || props || chr(10) || 'Summary:'
  ELSE props END AS prompt FROM events""")
def format_prompt(spark, sf):
    """Click -> decomposition prompt, view -> summarisation prompt, else unchanged."""
    e = read_table(spark, sf, "events")
    task = F.when(F.col("event_type") == "click", "decomposition").when(F.col("event_type") == "view", "summarization") \
        .otherwise("other")
    return e.select("event_id", D.format_prompt(F.col("props"), task).alias("prompt"))


@register("merge_metadata", """SELECT doc_id, 'category=' || lang || ',source=' || source || ',variation=true' AS metadata
FROM documents""")
def merge_metadata(spark, sf):
    """M3: {**base, "variation": true} (right side wins; overwritten keys removed first)."""
    d = read_table(spark, sf, "documents")
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("category"), F.col("lang"),
                        F.lit("variation"), F.lit("false"))
    extra = F.create_map(F.lit("variation"), F.lit("true"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)
    body = F.array_join(F.transform(F.array_sort(F.map_entries(merged)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("doc_id", body.alias("metadata"))


_DUR = """CASE event_type WHEN 'click' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || 'μs'
  WHEN 'view' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || 'ms'
  WHEN 'purchase' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || 's'
  WHEN 'signup' THEN 'varies'
  ELSE CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(value) AS BIGINT) + 1 AS VARCHAR) || 'ms' END"""


@register("parse_duration", f"""SELECT event_id, d AS duration,
  coalesce(TRY_CAST(regexp_extract(d, '^(\\d+)μs$', 1) AS BIGINT), 0) AS strict_us,
  round(TRY_CAST(regexp_extract(d, '^(\\d+(?:\\.\\d+)?)\\s*(ns|μs|µs|us|ms|s)$', 1) AS DOUBLE) *
    CASE regexp_extract(d, '^(\\d+(?:\\.\\d+)?)\\s*(ns|μs|µs|us|ms|s)$', 2) WHEN 'ns' THEN 0.001 WHEN 'μs' THEN 1.0
      WHEN 'µs' THEN 1.0 WHEN 'us' THEN 1.0 WHEN 'ms' THEN 1000.0 WHEN 's' THEN 1000000.0 END, 6) AS lenient_us
FROM (SELECT event_id, {_DUR} AS d FROM events)""")
def parse_duration(spark, sf):
    """M6: strict 'NNNμs' parse (else 0) and a lenient unit-aware parse (ranges, 'varies' -> null)."""
    e = read_table(spark, sf, "events")
    iv = F.col("value").cast("long").cast("string")
    d = (F.when(F.col("event_type") == "click", F.concat(iv, F.lit("μs")))
         .when(F.col("event_type") == "view", F.concat(iv, F.lit("ms")))
         .when(F.col("event_type") == "purchase", F.concat(iv, F.lit("s")))
         .when(F.col("event_type") == "signup", F.lit("varies"))
         .otherwise(F.concat(iv, F.lit("-"), (F.col("value").cast("long") + 1).cast("string"), F.lit("ms"))))
    x = e.select("event_id", d.alias("duration"))
    return x.select("event_id", "duration", T.duration_us(F.col("duration")).alias("strict_us"),
                    F.round(T.duration_us_lenient(F.col("duration")), 6).alias("lenient_us"))
