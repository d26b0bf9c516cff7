"""Chapter content: cleaning, paragraphs, rendering. Native but for the steps that need an element tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as T
from ..functions.rowwise import by_row
from . import extract

INDENT = "　　"
#: The template of a chapter page.
XHTML = (
    '<?xml version="1.0" encoding="UTF-8" ?>\n'
    '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="zh">\n<head>\n'
    '  <meta http-equiv="Content-Type" content="application/xhtml+xml; charset=utf-8" />\n  <title>',
    '</title>\n  <style type="text/css">\n    p {\n      text-indent: 2em;\n      letter-spacing: 1px;\n    }\n  </style>\n</head>\n<body>\n  <h2>',
    "</h2>\n  <div>\n    ",
    "\n  </div>\n</body>\n</html>",
)


@dataclass(frozen=True)
class ChapterRule:
    content: str = ""
    paragraph_tag_closed: bool = False
    paragraph_tag: str = ""
    filter_txt: str = ""
    filter_tag: str = ""
    next_chapter_link: str = ""


def _by_text(function, *args):
    return by_row(lambda x: None if x is None else function(x, *args))


def inner_html(html: Column, expr: str, tag_filter: str = "", once: bool = False) -> Column:
    """Inner HTML of the first match; null without one. once: filters on it don't run it a second time, and no filter passes
    below the projection that holds it."""
    run = _by_text(lambda page: extract.extract_inner(dom.parse(page), expr, tag_filter))
    return (run.asNondeterministic() if once else run)(html)


def without_tags(html: Column, selector: str) -> Column:
    return _by_text(extract.remove_selected, selector)(html) if selector.strip() else html


def clean(content: Column, title: Column, rule: ChapterRule) -> tuple[Column, Column]:
    """(title, content): invisible characters, references, the rule's texts and tags, a repeated heading and empty tags go;
    numbered titles get their usual form."""
    out = T.filter_text(T.strip_entities(T.strip_invisible(content)), rule.filter_txt)
    out = T.drop_heading(without_tags(out, rule.filter_tag), title)
    return T.number_title(title), T.drop_empty_tags(out)


def split_paragraphs(content: Column, pattern: str) -> Column:
    """Each non-empty part between matches in <p>; the whole in one if the pattern is empty or unusable."""
    if T.usable_pattern(pattern) is None:
        return F.concat(F.lit("<p>"), content, F.lit("</p>"))
    return F.concat_ws("", F.transform(parts(content, pattern), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))))


def parts(content: Column, pattern: str) -> Column:
    """array<string>: the non-empty parts between matches of a usable pattern; without one, the whole."""
    usable = T.usable_pattern(pattern)
    return F.array(content) if usable is None else F.filter(F.split(content, usable, -1), lambda p: p != "")


def paragraphs(content: Column, rule: ChapterRule) -> Column:
    """Content without attributes and ASCII white space, in <p> elements."""
    if rule.paragraph_tag_closed:
        return _by_text(lambda html: extract.paragraphs_closed(extract.clear_attributes(html)))(content)
    return split_paragraphs(_by_text(extract.clear_attributes)(content), rule.paragraph_tag)


def render_text(title: Column, content: Column) -> Column:
    """The title and the inner text of each <p>, indented; what stands outside of <p> is lost."""
    found = F.regexp_extract_all(content, F.lit("(?s)<p>(.*?)</p>"), 1)
    lines = F.transform(found, lambda p: F.concat(F.lit(INDENT), p, F.lit("\n")))
    return F.concat(title, F.lit("\n\n"), F.concat_ws("", lines))


def escape_xml(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def render_xhtml(title: Column, content: Column) -> Column:
    safe = escape_xml(title)
    return F.concat(F.lit(XHTML[0]), safe, F.lit(XHTML[1]), safe, F.lit(XHTML[2]), content, F.lit(XHTML[3]))


def render_chapters(chapters: DataFrame, rule: ChapterRule, output: str = "txt") -> DataFrame:
    """chapters (title, content) cleaned, in paragraphs and rendered as txt, epub or raw; null content stays null."""
    title, body = clean(F.col("content"), F.col("title"), rule)
    ready = chapters.withColumns({"__title": title, "__body": body}).withColumn("__body", paragraphs(F.col("__body"), rule))
    how = {"txt": render_text, "epub": render_xhtml, "raw": lambda t, c: c}[output]
    return ready.withColumns({"content": how(F.col("__title"), F.col("__body")), "title": F.col("__title")}).drop("__title", "__body")


def accepted(chapters: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chapters with content, chapters without)."""
    empty = F.coalesce(T.trim_unicode(F.col(content)), F.lit("")) == ""
    return chapters.where(~empty), chapters.where(empty)


def join_pages(pages: DataFrame, chapter: list[str], order: str, content: str, next_url: str, next_text: str, link_pattern: str = "") -> DataFrame:
    """(chapter..., content, n_pages): the pages of each chapter in order, up to and with the first that is the last one."""
    last = T.is_last_page(F.col(next_url), F.col(next_text), link_pattern).cast("int")
    ended = F.coalesce(F.sum(last).over(W.partitionBy(*chapter).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    return pages.withColumn("__ended", ended).where("__ended = 0").groupBy(*chapter).agg(F.concat_ws("", F.transform(parts, lambda p: p["c"])).alias("content"), F.count("*").alias("n_pages"))
