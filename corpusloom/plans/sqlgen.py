"""DuckDB SQL fragments rendered from the same rule data the Spark jobs use.

Only used to build oracle SQL strings for the correctness check.
"""

from __future__ import annotations

import re


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in needles) + ")"


def first_match(expr: str, rules, default: str, lower: bool = True) -> str:
    e = f"lower({expr})" if lower else expr
    parts = " ".join(f"WHEN {any_contains(e, needles)} THEN {lit(cat)}" for cat, needles in rules)
    return f"(CASE {parts} ELSE {lit(default)} END)"


_WORD_LIST = re.compile(r"^\\b\((\w+(?:\|\w+)*)\)\\b$")


def regex_count(expr: str, pattern: str) -> str:
    """Count of case-insensitive matches.

    RE2's \\b is ASCII-only while Python and Java treat accented letters as
    word characters, so a ``\\b(w1|w2)\\b`` word list is counted as whole
    Unicode word tokens equal to one of the words.
    """
    m = _WORD_LIST.match(pattern)
    if m:
        words = ", ".join(lit(w.lower()) for w in m.group(1).split("|"))
        return (f"len(list_filter(regexp_extract_all({expr}, '[\\pL\\pN_]+'), "
                f"lambda w: lower(w) IN ({words})))")
    return f"len(regexp_extract_all({expr}, {lit('(?i)' + pattern)}))"


def categorize_scored(expr: str, patterns, default: str) -> str:
    counts = [regex_count(expr, p) for _, p in patterns]
    best = "greatest(" + ", ".join(counts) + ")" if len(counts) > 1 else counts[0]
    whens = " ".join(f"WHEN {c} = {best} THEN {lit(cat)}" for c, (cat, _) in zip(counts, patterns))
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN {lit(default)} "
            f"WHEN {best} = 0 THEN {lit(default)} {whens} END)")


def categorize_context(text: str, path: str, repo: str, patterns, default: str, context_rules) -> str:
    p, r = f"lower(coalesce({path}, ''))", f"lower(coalesce({repo}, ''))"
    whens = " ".join(
        f"WHEN {any_contains(p if field == 'path' else r, needles)} THEN {lit(cat)}"
        for field, needles, cat in context_rules)
    return (f"(CASE WHEN {text} IS NULL OR {text} = '' THEN {lit(default)} {whens} "
            f"ELSE {categorize_scored(text, patterns, default)} END)")


def hash16(expr: str) -> str:
    return f"substr(sha256({expr}), 1, 16)"


def seeded_draw(seed: str, *keys: str) -> str:
    parts = " || ':' || ".join([lit(seed)] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT)"


def lines_of_code(expr: str) -> str:
    return f"len(list_filter(string_split({expr}, chr(10)), lambda l: regexp_matches(l, '\\S')))"


def indicator_count(expr: str, indicators) -> str:
    return " + ".join(f"len(regexp_extract_all(lower({expr}), {lit(i)}))" for i in indicators)


def complexity_score(expr: str, indicators) -> str:
    return (f"least((CAST({indicator_count(expr, indicators)} AS DOUBLE) / "
            f"CAST(greatest({lines_of_code(expr)}, 1) AS DOUBLE)) * 10.0, 10.0)")


def complexity_level(steps: str, score: str) -> str:
    return (f"(CASE WHEN {steps} >= 8 OR {score} >= 7.0 THEN 'extreme' "
            f"WHEN {steps} >= 6 OR {score} >= 5.0 THEN 'high' "
            f"WHEN {steps} >= 4 OR {score} >= 3.0 THEN 'medium' ELSE 'low' END)")


def _arr(xs) -> str:
    return "[" + ", ".join(str(x) for x in xs) + "]::INTEGER[]"


def template_values(templates, compat: bool = False, generic: bool = True) -> str:
    """Template rows as a VALUES table (category, step, action, resource, criticality, par, deps)."""
    from corpusloom.operators.examples import generic_steps, template_steps
    rows = []
    for cat, steps in template_steps(templates, compat).items():
        for st, a, res, crit, par, deps in steps:
            rows.append(f"({lit(cat)}, {st}, {lit(a)}, {lit(res)}, {lit(crit)}, {str(par).lower()}, {_arr(deps)})")
    if generic:
        for st, a, res, crit, par, deps in generic_steps(compat):
            rows.append(f"('__generic__', {st}, {lit(a)}, {lit(res)}, {lit(crit)}, {str(par).lower()}, {_arr(deps)})")
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(category, step, action, resource, criticality, par, deps))")


def timing_bounds(resource: str, criticality: str, base: str) -> tuple[str, str]:
    from corpusloom import rules as R
    lo = "CASE " + resource + " " + " ".join(f"WHEN {lit(k)} THEN {v[0]}" for k, v in R.BASE_TIMES_US.items()) + " END"
    hi = "CASE " + resource + " " + " ".join(f"WHEN {lit(k)} THEN {v[1]}" for k, v in R.BASE_TIMES_US.items()) + " END"
    m = "CASE " + criticality + " " + " ".join(
        f"WHEN {lit(k)} THEN {v}" for k, v in R.CRITICALITY_MULTIPLIERS.items()) + " END"
    return (f"CAST(trunc(({lo}) * (({m}) * ({base}))) AS BIGINT)",
            f"CAST(trunc(({hi}) * (({m}) * ({base}))) AS BIGINT)")


def critical_path_cte(steps_rel: str, key: str, anchor_rel: str) -> str:
    """Recursive CTE `cp(key, k, fin)`: finish times appended step by step."""
    return (f"cp AS (SELECT {key}, 0 AS k, []::BIGINT[] AS fin FROM {anchor_rel} UNION ALL "
            f"SELECT cp.{key}, cp.k + 1, list_append(cp.fin, s.us + coalesce(list_max(list_transform(s.deps, "
            f"lambda d: coalesce(cp.fin[d], 0))), 0)) FROM cp JOIN {steps_rel} s ON s.{key} = cp.{key} "
            f"AND s.step = cp.k + 1)")


_ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def unescape(expr: str) -> str:
    """The named references that occur in the pages, the ampersand last."""
    for name, char in _ENTITIES:
        expr = f"replace({expr}, {lit(name)}, {lit(char)})"
    return expr


def html_text(expr: str, tag: str = " ") -> str:
    """Markup without tags, line breaks as spaces, white space collapsed, references replaced."""
    bare = f"regexp_replace(regexp_replace({expr}, '<br[^>]*>', ' ', 'g'), '<[^>]*>', {lit(tag)}, 'g')"
    return unescape(f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))")


def html_without(expr: str, tags) -> str:
    """A page without comments, declarations and whole elements of the given tags."""
    for t in tags:
        expr = f"regexp_replace({expr}, '(?s)<{t}[^>]*>.*?</{t}>', '', 'g')"
    return f"regexp_replace(regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g')"


def html_elements(html: str, tag: str) -> str:
    """The texts, blanks left out, of all elements of a tag whose end a block tag may imply."""
    clean = html_without(html, ("script", "style"))
    return f"list_filter({html_element_texts(clean, tag)}, lambda x: x <> '')"


def html_element_texts(clean: str, tag: str) -> str:
    """The texts of all elements of a tag (or tags, as a pattern ``a|b``) in document order, from a page without scripts."""
    ends = r"(?s)(</(%s|article|body|main|footer|div|html)>|<(p|ul|div|footer|h1|pre|article)[ >]).*$" % tag
    return (f"list_transform(string_split_regex({clean}, '<({tag})>')[2:], lambda x: "
            f"{html_text(f'regexp_replace(x, {lit(ends)}, {lit(chr(0)[:0])})', '')})")
