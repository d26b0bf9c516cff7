"""Scalar functions as native Column expressions. None of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of patterns that come from rules: Unicode classes, only \n ends a line.
DIALECT = "(?Ud)"

#: Code points that cleaning removes.
INVISIBLE = r"[\p{C}\x{2028}\x{2029}\x{200B}\x{FEFF}]"
#: Titles of pages that hold a challenge instead of content.
CHALLENGE_TITLES = ["Just a moment...", "403 Forbidden", "Attention Required", "Checking your browser before accessing"]
#: Texts of links that lead out of a paginated chapter.
END_MARKS = ["下一章", "没有了", ">>", "书末页"]
#: Characters of file names and what stands for them.
FILE_NAME = (".:/\0", "。：／_")
FILE_NAME_WINDOWS = (':*?"<>/\\|', "：＊？'＜＞___")
#: Labels that are cut from authors and dates.
LABELS = ["作者：", "更新时间：", "最后更新："]


def usable_pattern(pattern: str) -> str | None:
    """The pattern for Spark, or None if it is empty, invalid or refers back to groups (no filter then)."""
    if not pattern or re.search(r"\\[1-9]", pattern):
        return None
    try:
        re.compile(re.sub(r"\\p\{[^}]*\}|\\x\{[^}]*\}", "x", pattern))
    except re.error:
        return None
    return DIALECT + pattern


def trim_unicode(col: Column) -> Column:
    return F.regexp_replace(col, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def blank_to_null(col: Column) -> Column:
    trimmed = trim_unicode(col)
    return F.when(trimmed != "", trimmed)


def strip_invisible(col: Column) -> Column:
    """Without control, format, private and unassigned code points; line ends and tabs go as well."""
    return F.regexp_replace(col, INVISIBLE, "")


def strip_entities(col: Column) -> Column:
    """Without character references; an & takes along all up to the next semicolon."""
    return F.regexp_replace(col, "&[^;]+;", "")


def whole_references(html: Column) -> Column:
    """html for a tree in which only references with their semicolon count: an &amp that a cut text left open stays as it stands.
    Scripts are not told apart from text."""
    return F.regexp_replace(html, r"&(?=#?[A-Za-z0-9])(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def as_written(html: Column) -> Column:
    """html for a tree whose serialised text gives, after written(), the references as they stand in the page."""
    return F.replace(html, F.lit("&"), F.lit("&amp;"))


def written(inner: Column) -> Column:
    """Inner HTML of a tree of as_written() in the page's own writing."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    return inner


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", "")


def strip_whitespace(col: Column) -> Column:
    return F.regexp_replace(col, r"\p{IsWhite_Space}", "")


def strip_ascii_space(col: Column) -> Column:
    return F.regexp_replace(col, r"[ \t\n\f\r]", "")


def drop_void_tags(col: Column, tags: list[str]) -> Column:
    return F.regexp_replace(col, rf"(?is)<(?:{'|'.join(map(re.escape, tags))})\b[^>]*/?>", "")


def drop_empty_tags(col: Column) -> Column:
    """One pass over pairs with nothing but white space between them."""
    return F.regexp_replace(col, r"(?i)<([a-z\d]+)([^<>]*)>\s*</\1>", "")


def filter_text(col: Column, pattern: str) -> Column:
    """Without what the rule's pattern finds; unusable patterns filter nothing."""
    usable = usable_pattern(pattern)
    return F.regexp_replace(col, usable, "") if usable else col


def drop_heading(content: Column, title: Column) -> Column:
    """Without the title, as it is or without white space, at the head of the content; the last lead-in token stays."""
    bare = strip_whitespace(title)
    quoted = lambda c: F.concat(F.lit("\\Q"), F.regexp_replace(c, r"\\E", r"\\\\E\\\\E\\\\Q"), F.lit("\\E"))
    pattern = F.concat(F.lit(r"^(\p{IsWhite_Space}|<[^>]+>)*(?:"), quoted(title), F.lit("|"), quoted(bare), F.lit(")"))
    return F.when(bare == "", content).otherwise(F.regexp_replace(content, pattern, F.lit("$1")))


def number_title(col: Column) -> Column:
    """`12. Name` as `第12章 Name`."""
    return F.regexp_replace(col, r"(?Ud)^(\d+)\s*\.\s*(.+)\z", "第$1章 $2")


def clean_label(col: Column) -> Column:
    for label in LABELS:
        col = F.replace(col, F.lit(label), F.lit(""))
    return col


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer, in code points; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def match_weight(s: Column, keyword: Column) -> Column:
    """Weight of a similarity; short keywords (4 code points at most) and long ones (10 at least) have their own bands."""
    n = F.length(keyword)
    exact = F.abs(s - 1.0) < 2.220446049250313e-16
    short = F.when(exact, 12.0).when(s >= 0.8, 8 * s * s * s).when(s >= 0.7, 5 * s).otherwise(0.0)
    rest = F.when(n >= 10, 1.2 * s).otherwise(0.0)
    usual = F.when(exact, 10.0).when(s >= 0.85, 8 * s * s * s).when(s >= 0.7, 5 * s * s).when(s >= 0.5, 3 * s).otherwise(rest)
    return F.when(n <= 4, short).otherwise(usual)


def fill_template(template: Column, keyword: Column) -> Column:
    return F.replace(template, F.lit("%s"), keyword)


def form_fields(template: Column, keyword: Column) -> Column:
    """`{k: v, ...}` as array<struct<k, v>>, in order, with the keyword filled in; entries without a colon go."""
    bare = F.regexp_replace(trim_unicode(template), r"^\{|\}$", "")
    unquoted = lambda c: F.regexp_replace(trim_unicode(c), r"^[\"']+|[\"']+$", "")
    entries = F.filter(F.split(bare, ","), lambda e: F.contains(e, F.lit(":")))
    return F.transform(
        entries,
        lambda e: F.struct(
            unquoted(F.substring_index(e, ":", 1)).alias("k"),
            fill_template(unquoted(F.regexp_replace(e, r"(?s)^[^:]*:", "")), keyword).alias("v"),
        ),
    )


def book_id(url: Column, pattern: str) -> Column:
    """First group of the rule's pattern (the part before a step) in the url; null without one."""
    usable = usable_pattern(pattern.split("@js:")[0].strip())
    if usable is None or re.compile(re.sub(r"^\(\?Ud\)", "", usable)).groups < 1:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(url, usable, 1), F.lit(""))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^(.*?://[^/]*)", 1), F.lit(""))


def absolute_url(value: Column, base: Column, compat: bool = False) -> Column:
    """A link in full. compat joins a relative link to its base's folder by one more slash, as sources of old rules expect,
    and reads //host as a path of the same origin."""
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    scheme = F.regexp_extract(base, "^([^:]*:)", 1)
    joined = F.concat(folder, F.lit("//" if compat else "/"), value)
    out = F.when(value.rlike("^https?://") | (base == ""), value)
    if not compat:
        out = out.when(value.startswith("//"), F.concat(scheme, value))
    return out.when(value.startswith("/"), F.concat(F.coalesce(origin(base), F.lit("")), value)).otherwise(joined)


def percent_encode(col: Column) -> Column:
    """UTF-8 bytes but for A-Z a-z 0-9 - _ . ~ as %XX."""
    out = F.url_encode(col)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_file_name(col: Column, windows: bool = False) -> Column:
    return F.translate(col, *(FILE_NAME_WINDOWS if windows else FILE_NAME))


def padded(index: Column, total: Column) -> Column:
    """The index with leading zeros, as wide as the total; a wider index stays whole."""
    digits = index.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.length(total.cast("string"))), F.lit("0"))


def decode_base64_lines(col: Column) -> Column:
    """Tokens that look like Base64, decoded and put together; tokens of odd length or content are skipped."""
    tokens = F.filter(F.regexp_extract_all(col, F.lit("[A-Za-z0-9+/]+={0,2}"), 0), lambda t: F.length(t) % 4 == 0)
    return F.concat_ws("", F.transform(tokens, lambda t: F.coalesce(F.make_valid_utf8(F.try_to_binary(t, F.lit("base64")).cast("string")), F.lit(""))))


def is_http(col: Column) -> Column:
    return F.coalesce(col.rlike("^https?://"), F.lit(False))


def is_challenge(html: Column) -> Column:
    """Whether the first title is exactly one of the known challenge titles."""
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1).isin(CHALLENGE_TITLES)


def is_last_page(next_url: Column, next_text: Column, link_pattern: str = "") -> Column:
    """Whether a chapter ends here: no next link, the rule's link of a next chapter, or a text that says so."""
    none = F.coalesce(next_url, F.lit("")) == ""
    usable = usable_pattern(link_pattern)
    by_rule = next_url.rlike(f"{DIALECT}^(?:{usable.removeprefix(DIALECT)})\\z") if usable else F.lit(False)
    numbered = next_url.rlike(r"(?d)^.*[-_]\d\.html\z")
    said = F.lit(False)
    for mark in END_MARKS:
        said = said | F.contains(F.coalesce(next_text, F.lit("")), F.lit(mark))
    return none | by_rule | (~numbered & said)


def json_state(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def job_id() -> Column:
    """16 random hexadecimal digits, new for each row; write them before they are used twice."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(16))
