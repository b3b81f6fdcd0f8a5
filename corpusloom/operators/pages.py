"""HTML extraction over page tables.

The regex forms are native expressions. The parser forms use Python's
standard ``html.parser`` inside an Arrow-batched pandas UDF (one parser pass
per page; bs4/lxml are not assumed to be installed).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIN_TAGS = ["main", "article", "body"]
DROP_TAGS = ["script", "style", "nav"]


def first_section(html: Column, tags=MAIN_TAGS) -> Column:
    """Inner HTML of the first of the tags present (regex form, lazy match)."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, f"(?s)<{t}[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in tags])


def strip_tags(html: Column) -> Column:
    """Tags -> spaces, whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def title(html: Column, default: str = "No title") -> Column:
    """H2 title with a default."""
    t = F.trim(F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", F.lit(default)).otherwise(t)


def pre_block(html: Column, css_class: str = "rfc-text") -> Column:
    """H5: text of <pre class="rfc-text">."""
    return F.regexp_extract(html, f'(?s)<pre class="{css_class}">(.*?)</pre>', 1)


def host_extension(url: Column) -> Column:
    """F3 on URLs: the last dot-suffix of the host."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    return F.regexp_extract(host, r"(\.[^.]+)$", 1)


def path_extension(url: Column) -> Column:
    """the last dot-suffix of the file name in the URL's path, lower-case; '' without one."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def with_extension(df: DataFrame, url_col: str, extensions, limit: int | None = None,
                   order_cols: list[str] | None = None) -> DataFrame:
    """rows whose URL path has one of the extensions; with ``limit``, the first so many of them."""
    kept = df.where(path_extension(F.col(url_col)).isin(list(extensions)))
    return kept if limit is None else kept.orderBy(*(order_cols or [url_col])).limit(limit)


def links(html: Column) -> Column:
    """All href values, in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def resolve(href: Column, page_url: Column) -> Column:
    """Absolute hrefs unchanged; relative ones joined to the page's scheme and host."""
    base = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("/"), F.concat(base, href))
            .otherwise(F.concat(base, F.lit("/"), href)))


def basename(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)$", 1)


def dedupe_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """first row per key (partial aggregation: hot keys collapse map-side)."""
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
            .select(key, "_r.*").select(*df.columns))


# elements without content, and start tags that end an open element of the named kinds
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_ENDS_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
           "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
IMPLIED_END = {**{t: ("p",) for t in _ENDS_P}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"),
               "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: an implied end doesn't reach beyond these
SCOPE = frozenset(("table", "ul", "ol", "dl", "body", "html", "select", "article", "main", "section", "div", "td", "th"))


class _PageParser(HTMLParser):
    """One pass over a page: text pieces with what is open around them, and the text of matched elements.

    A selector is a tag or ``.class`` name. A matched element gathers the text inside it, nested elements
    included, until it is closed, by its end tag, the end of an element around it, or a start
    tag that implies its end.
    """

    def __init__(self, drop=(), wanted=()):
        super().__init__(convert_charrefs=True)
        self.drop, self.wanted = frozenset(drop), frozenset(wanted)
        self.stack: list[tuple[str, frozenset, list | None]] = []
        self.pieces: list[tuple[frozenset, str]] = []
        self.elements: list[tuple[frozenset, list[str]]] = []    # in order of their start tags
        self.nested: list[bool] = []                             # whether each lies inside another

    def handle_starttag(self, tag, attrs):
        ends = IMPLIED_END.get(tag, ())
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in ends:
                del self.stack[depth:]
                break
            if self.stack[depth][0] in SCOPE:
                break
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text(" ")
            return
        classes = next((v for k, v in attrs if k == "class" and v), "")
        names = frozenset([tag] + ["." + c for c in classes.split()])
        gathered = None
        if names & self.wanted and not any(sel & self.drop for _, sel, _ in self.stack):
            gathered = []
            self.elements.append((names, gathered))
            self.nested.append(any(g is not None for _, _, g in self.stack))
        self.stack.append((tag, names, gathered))

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                del self.stack[depth:]
                break

    def handle_data(self, data):
        self._text(data)

    def _text(self, data):
        around = frozenset().union(*[sel for _, sel, _ in self.stack])
        if around & self.drop:
            return
        for _, _, gathered in self.stack:
            if gathered is not None:
                gathered.append(data)
        self.pieces.append((around, data))


def _clean(parts) -> str:
    return " ".join("".join(parts).split())


def _parsed(html: str | None, drop=(), wanted=()) -> _PageParser:
    p = _PageParser(drop, wanted)
    p.feed(html or "")
    p.close()
    return p


def _page_text(pieces) -> str:
    """Text pieces apart by one space, white space collapsed."""
    return " ".join(" ".join(s.split()) for _, s in pieces if s.strip())


def _parse_text(html: str | None, section: str | None, drop) -> str | None:
    if html is None:
        return None
    p = _parsed(html, drop)
    if section is None:
        return _page_text(p.pieces)
    for tag in MAIN_TAGS:
        inside = [piece for piece in p.pieces if tag in piece[0]]
        if any(s.strip() for _, s in inside):
            return _page_text(inside)
    return ""


@F.pandas_udf(T.StringType())
def main_text_parsed(html: pd.Series) -> pd.Series:
    """H1 (parser form): text of the first of main/article/body, one space between pieces."""
    return html.map(lambda h: _parse_text(h, "main", ()))


@F.pandas_udf(T.StringType())
def all_text_parsed(html: pd.Series) -> pd.Series:
    """H2 (parser form): all text except script, style and nav."""
    return html.map(lambda h: _parse_text(h, None, DROP_TAGS))


SELECT_SCHEMA = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


AUTO_CODE_SELECTORS = ["pre", "code", ".highlight", ".codehilite", ".language-python"]


def _select(html, selectors):
    wanted = set(AUTO_CODE_SELECTORS) if not selectors else {t for tags in selectors.values() for t in tags}
    p = _parsed(html, ("script", "style"), wanted)
    texts = [(names, _clean(parts)) for names, parts in p.elements]
    out = {}
    if not selectors:
        # no selectors: all text without script/style/nav, plus automatic code search
        out["all_text"] = [_page_text([x for x in p.pieces if "nav" not in x[0]])]
        code = [t for pattern in AUTO_CODE_SELECTORS for names, t in texts if pattern in names and t]
        if code:
            out["auto_code"] = code
        return out
    for name, tags in selectors.items():
        out[name] = [t for names, t in texts if names & set(tags) and t]
    return out


def select_udf(selectors: dict[str, list[str]]):
    """H3: named selectors (tag or ``.class`` names) -> arrays with the text of each matched element that
    isn't blank, in one parser pass; with no selectors, all text plus an automatic search over the code selectors."""
    @F.pandas_udf(SELECT_SCHEMA)
    def _sel(html: pd.Series) -> pd.Series:
        return html.map(lambda h: _select(h, selectors))
    return _sel


SPLIT_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("code", T.ArrayType(T.StringType()))])
_CODE = frozenset(("pre", "code"))


@F.pandas_udf(SPLIT_SCHEMA)
def split_code_text(html: pd.Series) -> pd.DataFrame:
    """H4: the text of each outermost pre/code element to ``code``, all other text to ``text``."""
    texts, codes = [], []
    for h in html:
        p = _parsed(h, ("script", "style"), _CODE)
        code = [_clean(parts) for (_, parts), nested in zip(p.elements, p.nested) if not nested]
        texts.append(_page_text([x for x in p.pieces if not x[0] & _CODE]))
        codes.append([c for c in code if c])
    return pd.DataFrame({"text": texts, "code": codes})


CONTEXT = frozenset(("p", "h1", "h2", "h3"))


def _context(html: str | None, tags: list[str], keywords: re.Pattern) -> list[str]:
    p = _parsed(html, ("script", "style"), CONTEXT | _CODE | set(tags))
    texts = [_clean(parts) for _, parts in p.elements]
    before, last = [], None          # of each element: the paragraph or heading that began last before it
    for i, (names, _) in enumerate(p.elements):
        before.append(last)
        if names & CONTEXT:
            last = i
    return [texts[before[i]] for tag in tags for i, (names, _) in enumerate(p.elements)
            if tag in names and not names & _CODE and before[i] is not None and texts[before[i]] and keywords.search(texts[i])]


def tutorial_context(tags: list[str], keywords: str):
    """H4, tutorials: for each element of ``tags`` (by tag, then in document order) whose text holds a keyword, the text of
    the p, h1, h2 or h3 element that began last before it; blank ones and code are left out."""
    pattern = re.compile(keywords)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def context(html: pd.Series) -> pd.Series:
        return html.map(lambda h: _context(h, tags, pattern))
    return context
