"""Column expressions for text: gates, hashes, rule-based categorisation,
symbol extraction, code metrics, rewrites.

All functions return ``Column`` objects built from built-in Spark SQL
functions, so they stay inside whole-stage codegen (no Python per row).
Regex patterns are Java regex. The rules are written for Unicode classes
(``\\w``, ``\\s``, ``\\b`` over all scripts, case folding beyond ASCII), which
Java needs the flags ``(?iuU)`` for; ``\\s`` also takes in U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import rules as R


FLAGS = "(?iuU)"
SPACE_CLASS = r"\s\x1c-\x1f"


def unicode_spaces(pattern: str) -> str:
    """A pattern whose ``\\s`` outside classes covers all Unicode white space."""
    return "(?U)" + pattern.replace(r"\s", f"[{SPACE_CLASS}]")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sql_str(s: str) -> str:
    """A Spark SQL string literal (used in `F.expr` lambdas)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- gates -----------------------------------------------------------------

def length_between(col, lo: int = R.MIN_CODE_LENGTH, hi: int = R.MAX_CODE_LENGTH) -> Column:
    """lo <= len(text) <= hi on the unstripped text (characters)."""
    n = F.length(_c(col))
    return (n >= lo) & (n <= hi)


def strip_ws(col) -> Column:
    """Python-style strip: removes leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"(?U)^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def stripped_length(col) -> Column:
    """length after a Python-style strip."""
    return F.length(strip_ws(col))


def non_empty(col) -> Column:
    """not null and not the empty string."""
    c = _c(col)
    return c.isNotNull() & (c != "")


# --- hashing ---------------------------------------------------------------

def hash16(col) -> Column:
    """First 16 hex characters of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(_c(col), 256), 1, 16)


def seeded_draw(seed: str, *keys) -> Column:
    """A deterministic non-negative integer in [0, 2^32) from md5(seed:keys).

    Replaces random draws so results are exact and reproducible; the same
    number is available in other engines from the first 8 hex digits.
    """
    parts = [F.lit(seed)] + [_c(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


# --- categorisation --------------------------------------------------------

def categorize_scored(col, patterns: Sequence[tuple[str, str]] = R.CATEGORY_PATTERNS,
                      default: str = R.DEFAULT_CATEGORY) -> Column:
    """Highest count of case-insensitive matches; tie -> first declared.

    Empty/null text and no match at all give ``default``. One ``array_max``
    over (score, -rank, category) structs; the default candidate has score 0
    and the highest rank key, so it wins exactly when every score is 0 and
    each pattern is evaluated once per row.
    """
    text = _c(col)
    scored = [
        F.struct(
            F.regexp_count(text, F.lit(FLAGS + pat)).alias("score"),
            F.lit(-rank).alias("neg_rank"),
            F.lit(cat).alias("category"),
        )
        for rank, (cat, pat) in enumerate(patterns)
    ]
    fallback = F.struct(F.lit(0).alias("score"), F.lit(1).alias("neg_rank"), F.lit(default).alias("category"))
    best = F.array_max(F.array(*scored, fallback))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(best["category"])


def category_scores(col, patterns: Sequence[tuple[str, str]] = R.CATEGORY_PATTERNS) -> Column:
    """Per-rule match counts as an array of structs (rank, category, score)."""
    text = _c(col)
    return F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(cat).alias("category"),
                 F.regexp_count(text, F.lit(FLAGS + pat)).alias("score"))
        for rank, (cat, pat) in enumerate(patterns)
    ])


def _any_contains(col: Column, needles: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(col, F.lit(n))
    return cond


def categorize_context(text, path, repo, patterns=R.CATEGORY_PATTERNS, default=R.DEFAULT_CATEGORY,
                       context_rules=R.CONTEXT_RULES) -> Column:
    """X2 then X1: path/repo substring overrides, in order, before scoring.

    The override needs non-empty text (empty text is ``default`` first).
    """
    t = _c(text)
    p = F.lower(F.coalesce(_c(path), F.lit("")))
    r = F.lower(F.coalesce(_c(repo), F.lit("")))
    out = F.when(t.isNull() | (t == ""), F.lit(default))
    for field, needles, cat in context_rules:
        out = out.when(_any_contains(p if field == "path" else r, needles), F.lit(cat))
    return out.otherwise(categorize_scored(t, patterns, default))


def categorize_first(col, rules=R.FIRST_MATCH_RULES, default=R.DEFAULT_CATEGORY) -> Column:
    """First category whose keyword is a substring of the lower-cased text."""
    low = F.lower(_c(col))
    out = None
    for cat, needles in rules:
        cond = _any_contains(low, needles)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(default))


def classify_keywords(col, rules, default: str) -> Column:
    """First rule whose keywords occur (substring) in the lower-cased value."""
    return categorize_first(col, rules, default)


def classify_resource(col, rules=R.RESOURCE_RULES, default: str = "CPU") -> Column:
    return classify_keywords(col, rules, default)


def classify_criticality(col, rules=R.CRITICALITY_RULES, default: str = R.DEFAULT_CRITICALITY) -> Column:
    return classify_keywords(col, rules, default)


def route_labels(col, routes) -> Column:
    """Array of every category whose substring occurs (case-sensitive)."""
    c = _c(col)
    return F.array_distinct(F.array_compact(F.array(*[
        F.when(_any_contains(c, needles), F.lit(cat)) for cat, needles in routes
    ])))


# --- code analysis ---------------------------------------------------------

def extract_all(col, pattern: str, group: int = 1) -> Column:
    """All matches of a group, in order, case-insensitive."""
    return F.regexp_extract_all(_c(col), F.lit(FLAGS + pattern), group)


def extract_functions(col, pattern: str = R.FUNCTION_PATTERN) -> Column:
    return F.filter(extract_all(col, pattern, 1), lambda x: x != "")


def extract_classes(col, pattern: str = R.CLASS_PATTERN) -> Column:
    return F.filter(extract_all(col, pattern, 1), lambda x: x != "")


def extract_imports(col, pattern: str = R.IMPORT_PATTERN) -> Column:
    """X4 imports: group 1 or else group 2 for every match (a missed group is '')."""
    g1 = extract_all(col, pattern, 1)
    g2 = extract_all(col, pattern, 2)
    return F.filter(F.zip_with(g1, g2, lambda a, b: F.when(a == "", b).otherwise(a)), lambda x: x != "")


def lines_of_code(col) -> Column:
    """Number of lines holding a non-whitespace character."""
    return F.size(F.filter(F.split(_c(col), "\n"), lambda l: l.rlike(f"(?U)[^{SPACE_CLASS}]")))


def complexity_indicator_count(col, indicators=R.COMPLEXITY_INDICATORS) -> Column:
    """Sum of plain-substring counts of the indicators in the lower-cased text."""
    low = F.lower(_c(col))
    total = None
    for ind in indicators:
        # non-overlapping substring count; indicators contain no regex metacharacters
        cnt = F.regexp_count(low, F.lit(ind))
        total = cnt if total is None else total + cnt
    return total


def complexity_score(col, indicators=R.COMPLEXITY_INDICATORS) -> Column:
    """min(count / max(loc, 1) * 10, 10.0), in that operation order."""
    cnt = complexity_indicator_count(col, indicators).cast("double")
    loc = F.greatest(lines_of_code(col), F.lit(1)).cast("double")
    return F.least((cnt / loc) * F.lit(10.0), F.lit(10.0))


def complexity_level(steps, score) -> Column:
    """extreme/high/medium/low from step count and code score."""
    s, c = _c(steps), _c(score)
    return (F.when((s >= 8) | (c >= 7.0), "extreme")
            .when((s >= 6) | (c >= 5.0), "high")
            .when((s >= 4) | (c >= 3.0), "medium")
            .otherwise("low"))


# --- rewrites --------------------------------------------------------------

def truncate_chars(col, n: int = 1000, suffix: str = "...") -> Column:
    """First n characters plus a suffix that is always appended."""
    return F.concat(F.substring(_c(col), 1, n), F.lit(suffix))


def collapse_blank_lines(col, pattern: str = R.BLANK_LINES_PATTERN) -> Column:
    """One pass of `\\n\\s*\\n\\s*\\n` -> two newlines."""
    return F.regexp_replace(_c(col), unicode_spaces(pattern), "\n\n")


def tag_text(col, tag_rules=R.TAG_RULES) -> Column:
    """Ordered rewrites; each inserts its tag before every match of its group."""
    out = _c(col)
    for pattern, tag in tag_rules:
        out = F.regexp_replace(out, pattern, tag.replace("$", "\\$") + "$1")
    return out


def truncate_lines(col, max_len: int = R.MAX_CODE_LENGTH, marker: str = "    # ... (truncated)") -> Column:
    """Keep whole lines while used + len(line) <= max_len - 100 (used grows
    by len + 1); when a line does not fit, append the marker and stop. Texts
    within max_len are returned unchanged."""
    c = _c(col)
    budget = max_len - 100
    lines = F.split(c, "\n", -1)
    acc = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"),
                 F.array().cast("array<string>").alias("out")),
        lambda a, l: F.when(a["stop"], a).when(
            a["used"] + F.length(l) > budget,
            F.struct(a["used"].alias("used"), F.lit(True).alias("stop"),
                     F.concat(a["out"], F.array(F.lit(marker))).alias("out")),
        ).otherwise(
            F.struct((a["used"] + F.length(l) + 1).alias("used"), F.lit(False).alias("stop"),
                     F.concat(a["out"], F.array(l)).alias("out"))
        ),
    )
    return F.when(F.length(c) <= max_len, c).otherwise(F.array_join(acc["out"], "\n"))


# --- durations -------------------------------------------------------------

def duration_us(col) -> Column:
    """M6 (strict form): integer before a trailing 'μs' (U+03BC), else 0."""
    return F.coalesce(F.regexp_extract(_c(col), "^(\\d+)μs$", 1).try_cast("long"), F.lit(0).cast("long"))


def duration_us_lenient(col) -> Column:
    """M6 (lenient form): ns, μs/µs, ms, s with an integer or decimal; else null."""
    c = F.trim(_c(col))
    num = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)\s*(ns|μs|µs|us|ms|s)$", 1).try_cast("double")
    unit = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)\s*(ns|μs|µs|us|ms|s)$", 2)
    factor = (F.when(unit == "ns", 0.001).when(unit.isin("μs", "µs", "us"), 1.0)
              .when(unit == "ms", 1000.0).when(unit == "s", 1000000.0))
    return num * factor
