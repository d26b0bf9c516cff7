"""Assembly of chapters to one artefact per book: ordered text, or an EPUB file as a binary column."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The words of a header.
NO_INTRO = "暂无"
HEADER = ("书名：", "\n作者：", "\n简介：", "\n")


def header(book_name: Column, author: Column, intro: Column) -> Column:
    shown = F.when(F.coalesce(intro, F.lit("")) == "", F.lit(NO_INTRO)).otherwise(T.strip_tags(intro))
    return F.concat(F.lit(HEADER[0]), book_name, F.lit(HEADER[1]), author, F.lit(HEADER[2]), shown, F.lit(HEADER[3]))


def ordered_text(chapters: DataFrame, book: list[str], index: str, content: str) -> DataFrame:
    """(book..., text, n_chapters): contents put together by index (no null contents)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    return chapters.groupBy(*book).agg(F.concat_ws("", F.transform(parts, lambda p: p["c"])).alias("text"), F.count("*").alias("n_chapters"))


def complete_books(chapters: DataFrame, book: list[str], ok: str) -> DataFrame:
    """Keys of the books whose chapters are all right; a book with one failure gives no artefact."""
    return chapters.groupBy(*book).agg(F.bool_and(ok).alias("__ok")).where("__ok").drop("__ok")


def encoded(text: str, encoding: str) -> bytes:
    """Bytes of a text; GBK and GB18030 both give GBK, with numeric references for what it lacks."""
    return text.encode("gbk", "xmlcharrefreplace") if encoding.upper() in ("GBK", "GB18030") else text.encode("utf-8")


def epub_bytes(book_name: str, author: str, intro: str, chapters: list[tuple[str, str]], cover: bytes | None = None) -> bytes:
    """An EPUB 2 container; raises ValueError for no chapters. Equal input gives equal bytes."""
    if not chapters:
        raise ValueError("a book needs chapters")
    files: list[tuple[str, bytes, str]] = []
    if cover:
        files.append(("cover.jpg", cover, "image/jpeg"))
        files.append(("cover.xhtml", b'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>cover</title></head><body><img src="cover.jpg" alt="cover"/></body></html>', "application/xhtml+xml"))
    width = len(str(len(chapters)))
    names = [f"chapter_{k:0{width}}.xhtml" for k in range(1, len(chapters) + 1)]
    files += [(n, c.encode(), "application/xhtml+xml") for n, (_, c) in zip(names, chapters, strict=True)]
    items = "".join(f'<item id="f{k}" href="{n}" media-type="{m}"/>' for k, (n, _, m) in enumerate(files))
    spine = "".join(f'<itemref idref="f{k}"/>' for k, (n, _, _) in enumerate(files) if n.endswith(".xhtml"))
    meta = f'<dc:title>{escape(book_name)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>zh</dc:language><dc:description>{escape(intro)}</dc:description><dc:identifier id="id">{escape(book_name + "/" + author)}</dc:identifier>'
    opf = f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, (t, _)) in enumerate(zip(names, chapters, strict=True), 1))
    ncx = f'<?xml version="1.0" encoding="UTF-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(book_name)}</text></docTitle><navMap>{points}</navMap></ncx>'
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, kind in [
            ("mimetype", b"application/epub+zip", zipfile.ZIP_STORED),
            ("META-INF/container.xml", container.encode(), zipfile.ZIP_DEFLATED),
            ("OEBPS/content.opf", opf.encode(), zipfile.ZIP_DEFLATED),
            ("OEBPS/toc.ncx", ncx.encode(), zipfile.ZIP_DEFLATED),
            *((f"OEBPS/{n}", d, zipfile.ZIP_DEFLATED) for n, d, _ in files),
        ]:
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data, kind)
    return out.getvalue()


def epub_books(chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, data): chapters (book, book_name, author, intro, index, title, content as XHTML, cover as JPEG if there is one) as
    one EPUB file a book.

    A task holds one book at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index", kind="stable")
        top = pdf.iloc[0]
        cover = top["cover"] if covered else None
        data = epub_bytes(top["book_name"] or "", top["author"] or "", top["intro"] or "", list(zip(pdf["title"], pdf["content"], strict=True)), cover)
        return pd.DataFrame({book: [top[book]], "data": [data]})

    kind, covered = chapters.schema[book].dataType.simpleString(), "cover" in chapters.columns
    return chapters.select(book, "book_name", "author", "intro", "index", "title", "content", *(["cover"] if covered else [])).groupBy(book).applyInPandas(run, f"{book} {kind}, data binary")


def chapter_file(index: Column, total: Column, title: Column, extension: str) -> Column:
    return F.concat(T.padded(index, total), F.lit("_"), T.safe_file_name(title), F.lit(f".{extension}"))


def book_folder(book_name: Column, author: Column, extension: str) -> Column:
    return T.safe_file_name(F.concat(book_name, F.lit(" ("), author, F.lit(f") {extension.upper()}")))


def file_order(name: Column) -> Column:
    """Number before the first _ of a file name; files without one come last."""
    return F.coalesce(F.regexp_extract(name, "^([^_]*)_", 1).try_cast("bigint"), F.lit(2**63 - 1))


def write_texts(books: DataFrame, folder: str, encoding: str = "UTF-8") -> None:
    """books (name, text), one whole file each, in a folder (a path or URI) that all tasks share; all of them or none."""
    from ..sources.filesink import write_files
    from .finish import encoded_texts

    write_files(encoded_texts(books.select(T.safe_file_name(F.col("name")).alias("name"), "text"), encoding), folder, folder=F.lit(""))
