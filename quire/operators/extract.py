"""Extraction from pages by compiled expressions: one tree per page for all fields.

Expressions that only need the title or a meta tag are lowered to native columns by lowered().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import dom, steps
from ..functions.rowwise import by_row, rows_of

#: Elements that tag filters remove on their own, without an end tag.
VOID_FILTERS = "br hr img input meta link source wbr".split()


def join_url(value: str, base: str) -> str:
    """A link in full."""
    if re.match(r"https?://", value) or not base:
        return value
    m = re.match(r"(?s)([^:]*:)//[^/]*", base)
    if value.startswith("//") and m:
        return m[1] + value
    if value.startswith("/"):
        return (m[0] if m else "") + value
    folder = re.sub(r"[?#].*$", "", base)
    cut = folder.rfind("/")
    return (folder[:cut] if cut > folder.find("://") + 2 else folder) + "/" + value


def _value(e: dom.Element, attr: str | None, base: str) -> str:
    if attr is None:
        return e.text().strip()
    value = e.attrs.get(attr.lower(), "")
    return join_url(value, base) if attr.lower() in ("href", "src") and value else value


def _stepped(x: steps.Extractor, value: str) -> str:
    for step in x.steps:
        value = steps.run(step, value)
    return value


def _rooted(css: str) -> str:
    return {"/html": "html", "/html/body": "body"}.get(css, css)


def extract(root: dom.Element, expr: str, base: str = "") -> str | None:
    """First match: its text or attribute, then the steps; None without a match or for an unusable selector."""
    return extract_parsed(root, steps.parse(expr), base)


def extract_parsed(root: dom.Element, x: steps.Extractor, base: str = "") -> str | None:
    """extract() with an expression that was taken apart."""
    try:
        e = dom.select_first(root, _rooted(x.css)) if x.css else None
    except dom.SelectorError:
        return None
    return None if e is None else _stepped(x, _value(e, x.attr, base))


def extract_inner(root: dom.Element, expr: str, tag_filter: str = "") -> str | None:
    """First match: its inner HTML, without the filtered tags, then the steps."""
    x = steps.parse(expr)
    try:
        e = dom.select_first(root, _rooted(x.css)) if x.css else None
    except dom.SelectorError:
        return None
    return None if e is None else _stepped(x, remove_tags(e.inner_html(), tag_filter))


def extract_href(e: dom.Element, expr: str, base: str) -> str:
    """Link of the first match within e, in full; the element itself if the expression has no selector."""
    x = steps.parse(expr)
    try:
        found = dom.select_first(e, x.css) if x.css else e
    except dom.SelectorError:
        return ""
    return "" if found is None else _stepped(x, _value(found, "href", base))


def extract_all(root: dom.Element, expr: str, attr: str, base: str = "") -> list[str]:
    """An attribute of all matches, links in full; matches without it are left out."""
    try:
        found = dom.select(root, _rooted(steps.parse(expr).css))
    except dom.SelectorError:
        return []
    return [_value(e, attr, base) for e in found if attr in e.attrs]


def remove_tags(html: str, tag_filter: str) -> str:
    """html without the elements that a list like `h3, div, p[style=x]` names; elements left open stay, class and id
    tokens name no element."""
    for token in filter(None, (t.strip() for t in tag_filter.split(","))):
        name, _, rest = token.partition("[")
        name = name.strip().lower()
        if not re.fullmatch(r"[a-z][a-z0-9]*", name):
            continue
        if name in VOID_FILTERS:
            html = re.sub(rf"(?is)<{name}\b[^>]*/?>", "", html)
            continue
        key, eq, value = rest.strip("[]").partition("=")
        want = re.compile(rf"""(?i)\b{re.escape(key.strip())}\s*=\s*["']?{re.escape(value.strip().strip("\"'").rstrip(";"))}""") if eq else None
        tag = re.compile(rf"(?is)<(/?){name}(?=[\s/>])[^>]*>")
        spans, open_ = [], []
        for m in tag.finditer(html):
            if not m[1]:
                if want is None or want.search(m[0]):
                    open_.append(m.start())
            elif open_:
                start = open_.pop()
                spans = [s for s in spans if s[0] < start] + [(start, m.end())]
        at, out = 0, []
        for a, b in spans:
            if a >= at:
                out.append(html[at:a])
                at = b
        html = "".join(out) + html[at:]
    return html


def remove_selected(html: str, selector: str) -> str:
    """html without all elements that the selector list matches; an unusable selector removes nothing. Unquoted attribute
    values count as quoted."""
    root = dom.parse(html)
    try:
        gone = {id(e) for e in dom.select(root, selector)}
    except dom.SelectorError:
        return html
    if not gone:
        return html
    todo = [root]
    while todo:
        e = todo.pop()
        e.children = [c for c in e.children if isinstance(c, str) or id(c) not in gone]
        todo += e.elements()
    return dom.body_of(root).inner_html()


def clear_attributes(html: str) -> str:
    root = dom.parse(html)
    for e in root.walk():
        e.attrs = {}
    return re.sub(r"[ \t\n\f\r]", "", dom.body_of(root).inner_html())


def paragraphs_closed(html: str) -> str:
    """Elements below the body become p while all elements around them are p."""
    root = dom.parse(html)
    body = dom.body_of(root)
    todo = body.elements()
    while todo:
        e = todo.pop()
        inner = e.name == "p"
        e.name = "p" if e.name not in dom.VOID else e.name
        if inner:
            todo += e.elements()
    return body.inner_html()


def lowered(html: Column, expr: str) -> Column | None:
    """The expression as a native column, where its shape allows: title, meta[property=..] and meta[name=..]."""
    x = steps.parse(expr)
    if any(s.name == "inline_b64" for s in x.steps):
        return None
    if x.css == "title" and x.attr is None:
        col = F.regexp_extract(html, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1)
    elif (m := re.fullmatch(r"""meta\[(property|name)=["']?([\w:.-]+)["']?\]""", x.css)) and x.attr == "content":
        col = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{m[1]}=["']?{re.escape(m[2])}["'\s/>])[^>]*\bcontent=["']([^"']*)["']""", 1)
    else:
        return None
    try:
        for step in x.steps:
            col = steps.column(step, col)
    except ValueError:  # a step without a native form
        return None
    return col


def extract_fields(pages: DataFrame, fields: dict[str, str], html: str = "html", base: str = "url", once: bool = False) -> DataFrame:
    """pages with one string column for each field; missing values are empty, null html has none.

    once: filters on the fields read the extracted rows and never extract a second time; other filters belong before it then.
    """

    def run(page: str | None, link: str | None) -> tuple[str, ...]:
        root = dom.parse(page or "")
        return tuple(extract(root, e, link or "") or "" for e in fields.values())

    udf = by_row(run, StructType([StructField(f, StringType()) for f in fields]))
    udf = udf.asNondeterministic() if once else udf  # keeps filters, and a second run of the function, above it
    return pages.withColumn("__x", udf(F.col(html), F.col(base))).select("*", "__x.*").drop("__x")


def list_rows(pages: DataFrame, key: str, rows: str, fields: dict[str, str], needed: str, limit: int = 0) -> DataFrame:
    """(key, pos, fields...): one row for each match of `rows` whose `needed` field is not empty, at most `limit` a page (0:
    all). A field ending in @href is a link in full; others are text."""

    def of_page(base: str | None, html: str | None) -> Iterator[tuple]:
        root = dom.parse(html or "")
        try:
            found = dom.select(root, _rooted(steps.parse(rows).css))
        except dom.SelectorError:
            found = []
        n = 0
        for e in found:
            made = {f: (extract_href(e, x, base or "") if "@href" in x else extract(e, x, base or "") or "") if x else e.text().strip() for f, x in fields.items()}
            if made[needed] and (not limit or n < limit):
                yield n, *made.values()
                n += 1

    return rows_of(pages, key, ["url", "html"], "pos int, " + ", ".join(f"{f} string" for f in fields), of_page)


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href): double-quoted hrefs of anchors in order, natively, from 0."""
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r'<a[^>]*\bhref="([^"]*)"'), 1)
    return pages.select(key, "url", F.posexplode(found).alias("pos", "href"))
