"""Search rows, book details and tables of contents, as source rules describe them, over captured pages.

One tree per page. Each projection gives its rows and, where a page can be unusable, the rejected pages with the
reason, so nothing vanishes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom, steps
from ..functions import text as T
from ..functions.rowwise import rows_of
from ..session import cut
from .content import inner_html, join_pages
from .extract import _rooted, extract, extract_all, extract_fields, extract_parsed, extract_href, extract_inner, join_url
from .toc import walk_links

SEARCH_FIELDS = ["author", "category", "latest_chapter", "last_update_time", "status", "word_count"]
DETAIL_FIELDS = ["book_name", "author", "intro", "cover_url", "category", "latest_chapter", "latest_chapter_url", "last_update_time", "status"]


def extract_text(e: dom.Element, expr: str) -> str:
    """Text of the first match within e, whatever attribute the expression names; a meta tag gives its content."""
    x = steps.parse(expr)
    if x.css.startswith("meta["):
        return extract(e, expr) or ""
    return extract_parsed(e, steps.Extractor(x.css, None, x.steps)) or ""


def _select(root: dom.Element, expr: str) -> list[dom.Element]:
    try:
        return dom.select(root, _rooted(steps.parse(expr).css)) if expr else []
    except dom.SelectorError:
        return []


def _rows(pages: DataFrame, key: str, columns: str, of_page: Callable[[dom.Element, str], list[tuple]]) -> DataFrame:
    """(key, columns...): the rows that of_page makes of each page's tree and base."""
    base = F.coalesce("base_uri", "url") if "base_uri" in pages.columns else F.col("url")
    based = pages.select(key, base.alias("base"), "html")
    return rows_of(based, key, ["base", "html"], columns, lambda base, html: of_page(dom.parse(html or ""), base or ""))


def search_rows(pages: DataFrame, rule: dict[str, str], key: str = "page_id", limit: int = 0) -> DataFrame:
    """(key, pos, book_name, url, author, category, latest_chapter, last_update_time, status, word_count): the results of
    search pages (key, url, html, base_uri if there is one).

    rule: result selects the rows, book_name names their text and, by its href, their link; the other fields may be absent
    and are empty then. Rows without a name are left out, and at most `limit` of the others stay (0: all).
    """

    def of_page(root: dom.Element, base: str) -> list[tuple]:
        out: list[tuple] = []
        for e in _select(root, rule["result"]):
            name = extract_text(e, rule["book_name"])
            if limit and len(out) >= limit:
                break
            if name:
                rest = [extract(e, rule[f], base) or "" if rule.get(f) else "" for f in SEARCH_FIELDS]
                out.append((len(out), name, extract_href(e, rule["book_name"], base), *rest))
        return out

    return _rows(pages, key, "pos int, book_name string, url string, " + ", ".join(f"{f} string" for f in SEARCH_FIELDS), of_page)


def all_pages(first: DataFrame, later: DataFrame, order: list[str], limit: int = 0, key: str = "source_id") -> DataFrame:
    """First and later result pages of each source in one, at most `limit` rows a source in order (0: all)."""
    from .search import limit_per_source

    return limit_per_source(first.unionByName(later), [key], order, limit)


def book_details(pages: DataFrame, rule: dict[str, str], key: str = "page_id", base: str = "url") -> tuple[DataFrame, DataFrame]:
    """(details, rejected): nine fields of each page (key, url, html), and (key, reason) of those without name or author.

    The author loses its label, the time too, the introduction all white space. Fields that the rule leaves out are empty.
    """
    made = extract_fields(pages.select(key, base, "html"), {f: rule.get(f, "") for f in DETAIL_FIELDS}, "html", base, once=True)
    unlabelled = F.col("author")
    for label in T.LABELS[:1]:
        unlabelled = F.replace(unlabelled, F.lit(label), F.lit(""))
    time = F.col("last_update_time")
    for label in T.LABELS[1:]:
        time = F.replace(time, F.lit(label), F.lit(""))
    whole = (F.col("book_name") != "") & (F.col("author") != "")
    rejected = made.where(~whole).select(key, F.when(F.col("book_name") == "", "no book name").otherwise("no author").alias("reason"))
    kept = made.where(whole).withColumns({"author": unlabelled, "last_update_time": time, "intro": F.regexp_replace("intro", r"(?U)\s", "")})
    return kept.select(key, *DETAIL_FIELDS), rejected


def toc_items(pages: DataFrame, item: str, container: str = "", key: str = "page_id") -> DataFrame:
    """(key, pos, title, url): entries of tables of contents, by `item`, within the inner HTML of `container` if one is named;
    links are completed with the outer page's base. Entries without a link have an empty one."""

    def of_page(root: dom.Element, base: str) -> list[tuple]:
        inner = dom.parse(extract_inner(root, container) or "") if container else root
        return [(k, e.text().strip(), join_url(e.attrs["href"], base) if "href" in e.attrs else "") for k, e in enumerate(_select(inner, item))]

    return _rows(pages, key, "pos int, title string, url string", of_page)


def toc_pages(pages: DataFrame, next_page: str, key: str = "page_id") -> DataFrame:
    """(key, kind, pos, url): where a table of contents goes on. A list of options names all its pages (kind "list": their
    href if one has it, else their value); otherwise the href, or else the value, of the next link (kind "next")."""

    def of_page(root: dom.Element, base: str) -> list[tuple]:
        found = _select(root, next_page)
        if any("value" in e.attrs for e in found):
            attr = "href" if any("href" in e.attrs for e in found) else "value"
            return [("list", k, join_url(v, base)) for k, v in enumerate(e.attrs[attr] for e in found if attr in e.attrs)]
        link = next((v for attr in ("href", "value") for v in extract_all(root, next_page, attr, base)[:1] if v), "")
        return [("next", 0, link)] if link else []

    return _rows(pages, key, "kind string, pos int, url string", of_page)


def attribute_rows(pages: DataFrame, expr: str, attr: str, key: str = "page_id") -> DataFrame:
    """(key, pos, value): an attribute of all matches of a page in order, from 0, links in full; matches without it have no row and
    no number. Null pages and unusable selectors have no rows."""
    return _rows(pages, key, "pos int, value string", lambda root, base: list(enumerate(extract_all(root, expr, attr, base))))


def without_entries(books: DataFrame, entries: DataFrame, book: str) -> DataFrame:
    """(book, reason): books whose table of contents is empty, which cannot go on."""
    return books.select(book).join(entries.select(book).distinct(), book, "left_anti").withColumn("reason", F.lit("empty table of contents"))


def next_links(pages: DataFrame, next_page: str, key: str = "url") -> DataFrame:
    """(key, next_url, next_text): where a page of a chapter goes on: the href of the first link that matches, in full, and the
    texts of all that match, one after another; both empty without a match."""

    def of_page(root: dom.Element, base: str) -> list[tuple]:
        found = _select(root, next_page)
        href = found[0].attrs.get("href", "") if found else ""
        return [(join_url(href, base) if href else "", "".join(e.text() for e in found))]

    return _rows(pages, key, "next_url string, next_text string", of_page)


def chapter_walk(spark: SparkSession, starts: DataFrame, pages: DataFrame, content_expr: str, next_page: str, tag_filter: str = "", link_pattern: str = "") -> tuple[DataFrame, DataFrame]:
    """(chapters, rejected): chapters (start, content, n_pages) whose first pages are starts (start), from captured pages (url,
    html, unique by url); rejected (start, reason) if a page that belongs to a chapter was not captured or has no content, or if the pages go round."""
    links = next_links(pages, next_page)
    ends = T.is_last_page(F.col("next_url"), F.col("next_text"), link_pattern)
    goes_on = links.select("url", F.when(~ends, F.col("next_url")).alias("next_url"))
    walk, rounds = walk_links(spark, starts, goes_on)
    own = pages.select("url", inner_html(F.col("html"), content_expr, tag_filter).alias("content")).join(links, "url")
    read = cut(walk.join(own, "url", "left"))
    lost = read.where(F.coalesce("content", F.lit("")) == "").groupBy("start").agg(F.min_by("url", "depth").alias("url"))
    rejected = lost.select("start", F.concat(F.lit("no content: "), "url").alias("reason"))
    round_ = rounds.join(lost.select("start"), "start", "left_anti")
    rejected = rejected.unionByName(round_.select("start", F.concat(F.lit("the pages go round: "), "url").alias("reason")))
    whole = read.join(rejected.select("start"), "start", "left_anti")
    return join_pages(whole, ["start"], "depth", "content", "next_url", "next_text", link_pattern), rejected
