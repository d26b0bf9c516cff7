"""Pages of many sources, each read by the rule of its own source: search rows, books, tables of contents, chapters.

A page meets its rule by an equal join on the rule's id, which match_rules() finds from the page's address unless the page
already has one. The rule travels with the page as JSON and is compiled once in each worker, so any number of sources is read in
one scan, with one tree a page. Keys stay in Spark, so they keep every digit.

Where pages follow one another, the walk is a join of addresses with what the scan found; nothing is fetched. Pages that are
missing or unusable, and walks that go round, come back as rejected rows with their reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom, steps
from ..functions.memo import memo
from ..functions.rowwise import rows_of
from ..functions import text as T
from ..session import cut
from ..sources import rules as R
from .extract import _rooted, extract, extract_href, extract_inner, join_url
from .projections import extract_text
from .toc import keep_last, renumber, walk_links

#: Names of the fields of a search row and of a book, by their name in a rule.
SEARCH = {"author": "author", "category": "category", "latestChapter": "latest_chapter", "lastUpdateTime": "last_update_time", "status": "status", "wordCount": "word_count"}
BOOK = {"bookName": "book_name", "author": "author", "intro": "intro", "coverUrl": "cover_url", "category": "category", "latestChapter": "latest_chapter", "latestChapterUrl": "latest_chapter_url", "lastUpdateTime": "last_update_time", "status": "status"}
SECTIONS = ("search", "book", "toc", "chapter")
PARTS = ("search", "book", "toc")

Section = dict[str, Any]


@memo(4096)
def _plan(rule: str) -> dict[str, Any]:
    return json.loads(rule)


@memo(4096)
def _whole(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(f"(?:{pattern})\\Z") if pattern else None
    except re.error:
        return None


def with_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with rule_id, found by address if they have none, and __rule, the rule as JSON; both null without a rule."""
    own = [c for c in (*SECTIONS, "disabled") if c in rules.columns]
    plans = rules.select(F.col("id").alias("rule_id"), F.to_json(F.struct(*own)).alias("__rule"))
    known = pages if "rule_id" in pages.columns else R.match_rules(pages, rules, key).drop("rule_name")
    return known.join(plans, "rule_id", "left")


def _select(root: dom.Element, expr: str | None) -> list[dom.Element]:
    try:
        return dom.select(root, _rooted(steps.parse(expr).css)) if expr else []
    except dom.SelectorError:
        return []


def _search(root: dom.Element, s: Section, base: str, limit: int) -> Iterator[dict[str, str]]:
    n = 0
    for e in _select(root, s.get("result")):
        name = extract_text(e, s.get("bookName") or "")
        if limit and n >= limit:
            return
        if name:
            n += 1
            rest = {to: extract(e, s[f], base) or "" if s.get(f) else "" for f, to in SEARCH.items()}
            yield {"book_name": name, "url": extract_href(e, s["bookName"], base), **rest}


def _book(root: dom.Element, s: Section, base: str) -> dict[str, str]:
    made = {to: extract(root, s[f], base) or "" if s.get(f) else "" for f, to in BOOK.items()}
    for name, labels in (("author", T.LABELS[:1]), ("last_update_time", T.LABELS[1:])):
        for label in labels:
            made[name] = made[name].replace(label, "")
    return made | {"intro": re.sub(r"\s", "", made["intro"])}


def _items(root: dom.Element, s: Section) -> list[tuple[int, str, str | None]]:
    """(pos, title, href as it stands) of a table of contents; where it lists the last first, pos falls."""
    inner = dom.parse(extract_inner(root, s["list"]) or "") if s.get("list") else root
    sign = -1 if s.get("isDesc") else 1
    return [(sign * k, e.text().strip(), e.attrs.get("href")) for k, e in enumerate(_select(inner, s.get("item")))]


def _read(root: dom.Element, rule: dict[str, Any], url: str, parts: tuple[str, ...], limit: int) -> Iterator[tuple[str, int, dict[str, str], str | None]]:
    """(part, pos, fields, reason) of one page; reason is null for rows that were read."""
    for part in parts:
        s = rule.get(part)
        if s is None:
            continue
        base = s.get("baseUri") or url
        rows: list[tuple[int, dict[str, str]]] = []
        why = ""
        if part == "search":
            if rule.get("disabled") or s.get("disabled"):
                why = "the source is not searched"
            else:
                rows, why = list(enumerate(_search(root, s, base, limit))), "no results"
        elif part == "book":
            made = _book(root, s, base)
            why = "no book name" if not made["book_name"] else "no author" if not made["author"] else ""
            rows = [] if why else [(0, made)]
        else:
            rows = [(pos, {"title": title, "url": "" if href is None else join_url(href, base)}) for pos, title, href in _items(root, s)]
            why = "empty table of contents"
        for pos, fields in rows:
            yield part, pos, fields, None
        if not rows:
            yield part, 0, {}, why


def read_sites(pages: DataFrame, rules: DataFrame, key: str = "page_id", parts: tuple[str, ...] = PARTS, limit: int = 0) -> DataFrame:
    """(key, rule_id, part, pos, fields, reason): all that the rules of their sources find in pages (key, url, html), in one scan.

    part is search, book or toc; a rule without that section gives nothing for it. Rows that were read have a null reason;
    a page that gives no row for a part has one row that says why; a page without a rule has one of part `rule`. limit: search
    rows a page at most (0: all). Null html counts as an empty page. Addresses are completed with the section's baseUri, or else
    the page's own address. search_of(), books_of(), toc_of() and rejected_of() take the result apart; stage it (cut) if more
    than one of them is used.
    """

    def of_page(rule_id: int | None, rule: str | None, url: str | None, html: str | None) -> Iterator[tuple]:
        if rule is None:
            yield rule_id, "rule", 0, {}, "no source"
            return
        for part, pos, fields, reason in _read(dom.parse(html or ""), _plan(rule), url or "", parts, limit):
            yield rule_id, part, pos, fields, reason

    schema = "rule_id int, part string, pos int, fields map<string,string>, reason string"
    ready = with_rules(pages.select(key, "url", "html", *(["rule_id"] if "rule_id" in pages.columns else [])), rules, key).withColumn("rule_id", F.col("rule_id").cast("int"))
    return rows_of(ready, key, ["rule_id", "__rule", "url", "html"], schema, of_page)


def _of(read: DataFrame, part: str, names: list[str]) -> DataFrame:
    own = read.where((F.col("part") == part) & F.col("reason").isNull())
    return own.select(*[c for c in read.columns if c not in ("part", "fields", "reason")], *(F.col("fields")[n].alias(n) for n in names))


def search_of(read: DataFrame) -> DataFrame:
    """(key, rule_id, pos, book_name, url, ...) of what read_sites() gave."""
    return _of(read, "search", ["book_name", "url", *SEARCH.values()])


def books_of(read: DataFrame) -> DataFrame:
    return _of(read, "book", list(BOOK.values())).drop("pos")


def toc_of(read: DataFrame) -> DataFrame:
    return _of(read, "toc", ["title", "url"])


def rejected_of(read: DataFrame) -> DataFrame:
    """(key, rule_id, part, reason)"""
    return read.where(F.col("reason").isNotNull()).drop("pos", "fields")


def toc_starts(books: DataFrame, rules: DataFrame, book: str = "book") -> DataFrame:
    """(book, rule_id, url, base, paged): where the table of contents of each book (book, url) begins, the base of its links, and
    whether it goes on over several pages. The first group of the pattern in the rule's book address is the book's id; it takes
    the place of %s in both. Books without a rule have a null rule_id."""

    def of_book(rule_id: int | None, rule: str | None, url: str | None) -> Iterator[tuple]:
        plan = _plan(rule) if rule else {}
        s, pattern = plan.get("toc") or {}, ((plan.get("book") or {}).get("url") or "").split("@js:")[0]
        try:
            m = re.search(pattern, url or "") if pattern else None
        except re.error:
            m = None
        id_ = m[1] if m and m.re.groups else None
        start, base = s.get("url") or "", s.get("baseUri") or ""
        if id_ is not None:
            start, base = start.replace("%s", id_), base.replace("%s", id_)
        yield rule_id if rule else None, start or url, base or url, bool(s.get("nextPage"))

    ready = with_rules(books.select(book, "url", *(["rule_id"] if "rule_id" in books.columns else [])), rules, book).withColumn("rule_id", F.col("rule_id").cast("int"))
    return rows_of(ready, book, ["rule_id", "__rule", "url"], "rule_id int, url string, base string, paged boolean", of_book)


def toc_scan(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, items, listed, next, next_value): what a table of contents has on each page (url, html), as it stands there:
    entries (pos, title, href); the pages that a drop-down lists; the href and the value of the first link that leads on."""

    def of_page(rule_id: int | None, rule: str | None, html: str | None) -> Iterator[tuple]:
        s = (_plan(rule).get("toc") if rule else None) or {}
        if not s:
            return
        root = dom.parse(html or "")
        found = _select(root, s.get("nextPage"))
        listed = None
        if any("value" in e.attrs for e in found):
            attr = "href" if any("href" in e.attrs for e in found) else "value"
            listed = [e.attrs[attr] for e in found if attr in e.attrs]
        first = found[0].attrs if found else {}
        items = [{"pos": p, "title": t, "href": h} for p, t, h in _items(root, s)]
        yield rule_id, items, listed, first.get("href", ""), first.get("value", "")

    schema = "rule_id int, items array<struct<pos:int,title:string,href:string>>, listed array<string>, next string, next_value string"
    ready = with_rules(pages.select("url", "html", *(["rule_id"] if "rule_id" in pages.columns else [])), rules, "url").withColumn("rule_id", F.col("rule_id").cast("int"))
    return rows_of(ready, "url", ["rule_id", "__rule", "html"], schema, of_page)


def tables_of_contents(books: DataFrame, pages: DataFrame, rules: DataFrame, book: str = "book") -> tuple[DataFrame, DataFrame]:
    """(entries, rejected): the numbered table of contents of each book (book, url), from its start over all of its captured
    pages (url, html; unique by url).

    entries: (book, index, title, url). The pages of a book are those that a drop-down on its first page lists, in that order
    (the first page itself stands where the list has it, or before it), or else those that follow one another by next links, as
    long as these are http links. Entries listed last first are turned round within their page; of equal titles the last
    stays. rejected: (book, url, reason, whole): a listed page that was not captured costs its own entries only (whole is
    false); a book without a source or first page, whose chain breaks off or goes round, or without entries, is out (true).

    Pages are parsed in one scan. Each step of a chain is one join of narrow rows, so there are as many rounds as the longest
    chain has pages; lists take none.
    """
    starts = cut(toc_starts(books, rules, book))
    scan = cut(toc_scan(pages, rules))
    links = scan.select("url", "rule_id", "listed", "next", "next_value")
    rejected = [starts.where("rule_id IS NULL").select(book, "url", F.lit("no source").alias("reason"))]
    first = starts.where("rule_id IS NOT NULL")
    seen = cut(first.join(links, ["rule_id", "url"], "left").select(*first.columns, "listed", "next", "next_value", F.col("next").isNotNull().alias("there")))
    rejected.append(seen.where(~F.col("there")).select(book, "url", F.lit("not captured").alias("reason")))
    # a drop-down: of equal addresses the last place counts, as each one is taken out and put at the end
    options = seen.where("paged AND listed IS NOT NULL").select(book, "rule_id", "base", F.posexplode("listed").alias("page_no", "raw"))
    options = options.select(book, "rule_id", "base", (F.col("page_no") + 1).alias("page_no"), T.absolute_url(F.col("raw"), F.col("base")).alias("url"))
    heads = seen.where("there").select(book, "rule_id", "base", F.lit(0).alias("page_no"), "url")
    # a chain, step by step
    leads = F.when(F.col("next") != "", T.absolute_url(F.col("next"), F.col("base"))).otherwise(F.col("next_value"))
    to = lambda df: df.where(T.is_http(leads)).select(book, "rule_id", "base", (F.col("page_no") + 1).alias("page_no"), leads.alias("url"))
    chain = cut(to(seen.where("paged AND there AND listed IS NULL").withColumn("page_no", F.lit(0))))
    visited = heads
    while not chain.isEmpty():
        round_ = chain.join(visited.select(book, "url"), [book, "url"], "left_semi")
        rejected.append(round_.select(book, "url", F.lit("the pages go round").alias("reason")))
        chain = chain.join(visited.select(book, "url"), [book, "url"], "left_anti")
        met = cut(chain.join(links, ["rule_id", "url"], "left").select(*chain.columns, "next", "next_value"))
        rejected.append(met.where("next IS NULL").select(book, "url", F.lit("not captured").alias("reason")))
        visited = cut(visited.unionByName(met.where("next IS NOT NULL").select(*visited.columns)))
        chain = cut(to(met.where("next IS NOT NULL")))
    out = rejected[0]
    for r in rejected[1:]:
        out = out.unionByName(r)
    out = cut(out.withColumn("whole", F.lit(True)))
    all_pages = visited.unionByName(options).groupBy(book, "rule_id", "base", "url").agg(F.max("page_no").alias("page_no"))
    all_pages = cut(all_pages.join(out.select(book), book, "left_anti").join(scan.select("rule_id", "url", "items"), ["rule_id", "url"], "left"))
    lost = all_pages.where("items IS NULL").select(book, "url", F.lit("not captured").alias("reason"), F.lit(False).alias("whole"))
    entries = all_pages.select(book, "base", "page_no", F.inline("items"))
    entries = entries.withColumn("url", F.when(F.col("href").isNotNull(), T.absolute_url(F.col("href"), F.col("base"))).otherwise(""))
    made = renumber(keep_last(entries, [book], "title", ["page_no", "pos"]), [book], ["page_no", "pos"]).select(book, "index", "title", "url")
    empty = heads.join(out.select(book), book, "left_anti").join(entries.select(book).distinct(), book, "left_anti").select(book, "url", F.lit("empty table of contents").alias("reason"), F.lit(True).alias("whole"))
    return made, out.unionByName(lost).unionByName(empty)


def _is_last(next_url: str, next_text: str, pattern: str) -> bool:
    """Whether a chapter ends on a page: as functions.text.is_last_page(), with a pattern of the page's own rule."""
    own = _whole(pattern)
    if not next_url or own and own.match(next_url):
        return True
    return not re.match(r"[^\n]*[-_]\d\.html\Z", next_url) and any(mark in next_text for mark in T.END_MARKS)


def chapter_scan(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, content, next): the content of each page of a chapter (url, html) and the page that follows, null if the
    chapter ends here. The link stands in an element, or in a script if the rule says how to read it from there."""

    def of_page(rule_id: int | None, rule: str | None, url: str | None, html: str | None) -> Iterator[tuple]:
        s = (_plan(rule).get("chapter") if rule else None) or {}
        if not s:
            return
        root = dom.parse(html or "")
        content = extract_inner(root, s.get("content") or "", s.get("filterTag") or "") or ""
        follows = None
        if s.get("nextPage"):
            found = _select(root, s["nextPage"])
            if s.get("nextPageInJs"):
                link = extract_inner(root, s["nextPageInJs"]) or ""
            else:
                href = found[0].attrs.get("href", "") if found else ""
                link = join_url(href, s.get("baseUri") or url or "") if href else ""
            if not _is_last(link, "".join(e.text() for e in found), s.get("nextChapterLink") or ""):
                follows = link
        yield rule_id, content, follows

    ready = with_rules(pages.select("url", "html", *(["rule_id"] if "rule_id" in pages.columns else [])), rules, "url").withColumn("rule_id", F.col("rule_id").cast("int"))
    return rows_of(ready, "url", ["rule_id", "__rule", "url", "html"], "rule_id int, content string, next string", of_page)


def walk_chapters(spark: SparkSession, starts: DataFrame, pages: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, rejected): chapters (start, content, n_pages) whose first pages are starts (start), from captured pages (url, html;
    unique by url), each walked by the rule of its source over any number of pages.

    rejected (start, url, reason): no source; a page of the chapter that was not captured or has no content, the first such one;
    a walk that comes back to a page it has already taken. Repeated starts count once. Pages are parsed in one scan; the length
    of the walks doubles with each round.
    """
    named = with_rules(starts.select("start").distinct().withColumn("url", F.col("start")), rules, "start").select("start", F.col("rule_id").cast("int"))
    named = cut(named)
    scan = cut(chapter_scan(pages, rules))
    node = lambda url: F.concat(F.col("rule_id"), F.lit(" "), F.col(url))
    edges = scan.where("next IS NOT NULL").select(node("url").alias("url"), node("next").alias("next_url"))
    walk, rounds = walk_links(spark, named.where("rule_id IS NOT NULL").select(node("start").alias("start")), edges)
    read = cut(walk.join(scan.select(node("url").alias("url"), "content"), "url", "left"))
    bare = lambda c: F.regexp_replace(c, r"^\d+ ", "")
    lost = read.where(F.coalesce("content", F.lit("")) == "").groupBy("start").agg(F.min_by(F.struct("url", F.when(F.col("content").isNull(), "not captured").otherwise("no content").alias("reason")), "depth").alias("x")).select("start", "x.url", "x.reason")
    round_ = rounds.join(lost.select("start"), "start", "left_anti").select("start", "url", F.lit("the pages go round").alias("reason"))
    out = lost.unionByName(round_)
    whole = read.join(out.select("start"), "start", "left_anti")
    parts = F.array_sort(F.collect_list(F.struct("depth", "content")))
    chapters = whole.groupBy("start").agg(F.concat_ws("", F.transform(parts, lambda p: p["content"])).alias("content"), F.count("*").alias("n_pages"))
    nowhere = named.where("rule_id IS NULL").select("start", F.col("start").alias("url"), F.lit("no source").alias("reason"))
    return chapters.withColumn("start", bare("start")), out.withColumns({"start": bare("start"), "url": bare("url")}).unionByName(nowhere)
