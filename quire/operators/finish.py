"""From rendered chapters to artefacts: a cache of chapter files, its scan in order, and one finished file for each book.

Files go through sources.filesink: a job's files appear when it commits, also if a task is run again or twice, and a job that
fails leaves none. A task holds one file at a time.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources import filesink
from . import assemble

#: Formats of finished books, and the extension of a chapter in the cache of each.
CACHED_AS = {"txt": "txt", "epub": "html"}


def finished_name(book_name: Column, author: Column, extension: str) -> Column:
    return F.concat(F.coalesce(book_name, F.lit("")), F.lit("("), F.coalesce(author, F.lit("")), F.lit(f").{extension}"))


def chapter_files(chapters: DataFrame, extension: str = "txt") -> DataFrame:
    """(folder, name, content): where each chapter (book_name, author, index, total, title, content) is cached."""
    name = assemble.chapter_file(F.col("index"), F.col("total"), F.col("title"), CACHED_AS[extension])
    return chapters.select(assemble.book_folder(F.col("book_name"), F.col("author"), extension).alias("folder"), name.alias("name"), F.coalesce("content", F.lit("")).alias("content"))


def write_cache(files: DataFrame, cache: str) -> None:
    """files (folder, name, content) below the folder `cache`, a path or URI, in UTF-8; all of them or, if the job fails, none."""
    filesink.write_files(files, cache, data=F.encode("content", "UTF-8"))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """(folder, name, index, title, content): the chapters below `cache`. index is the number before the first _ (names without one come
    last); files that are no UTF-8 and files half written are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(cache)
    plain = lambda k: F.url_decode(F.replace(F.element_at(F.split("path", "/"), k), F.lit("+"), F.lit("%2B")))
    files = found.select(plain(-2).alias("folder"), plain(-1).alias("name"), F.col("content").cast("string").alias("content"))
    whole = files.where(~F.startswith("name", F.lit(".")) & F.is_valid_utf8("content"))
    title = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "^[^_]*_", "")
    return whole.select("folder", "name", assemble.file_order(F.col("name")).alias("index"), title.alias("title"), "content")


def finished_texts(books: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(key, name, text): each of books (key, book_name, author, intro) as its header and its chapters (key, index, content)
    in order. A book without chapters is its header."""
    top = books.select(key, finished_name(F.col("book_name"), F.col("author"), "txt").alias("name"), assemble.header(F.col("book_name"), F.col("author"), F.col("intro")).alias("__top"))
    return top.join(assemble.ordered_text(chapters, [key], "index", "content"), key, "left").select(key, "name", F.concat("__top", F.coalesce("text", F.lit(""))).alias("text"))


def encoded_texts(texts: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """texts (.., text) with `data`, their bytes; UTF-8 without Python."""
    if encoding.upper() not in ("GBK", "GB18030"):
        return texts.withColumn("data", F.encode("text", "UTF-8"))

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else assemble.encoded(t, encoding))

    return texts.withColumn("data", run("text"))


def finish_books(spark: SparkSession, books: DataFrame, cache: str, out: str, extension: str = "txt", encoding: str = "UTF-8", keep_cache: bool = False) -> DataFrame:
    """Finished files of books (book_name, author, intro, cover if there is one) in the folder `out`, from their chapters below `cache`;
    gives (folder, name) of each. The cache of a finished book goes unless it is kept; after a failure all caches are there.

    ValueError for another format than txt and epub. An EPUB of a book without chapters is not made; its name is not given.
    """
    if extension not in CACHED_AS:
        raise ValueError(f"no such format: {extension}")
    known = books.withColumn("folder", assemble.book_folder(F.col("book_name"), F.col("author"), extension)).dropDuplicates(["folder"])
    chapters = read_cache(spark, cache)
    name = finished_name(F.col("book_name"), F.col("author"), extension)
    if extension == "txt":
        made = encoded_texts(finished_texts(known, chapters, "folder"), encoding).select("folder", "name", "data")
    else:
        cover = ["cover"] if "cover" in books.columns else []
        whole = chapters.join(known.select("folder", "book_name", "author", "intro", *cover), "folder")
        made = assemble.epub_books(whole, "folder").join(known.select("folder", name.alias("name")), "folder").select("folder", "name", "data")

    filesink.write_files(made.withColumn("name", F.replace("name", F.lit("/"), F.lit("／"))), out, folder=F.lit(""))
    done = known.select("folder", name.alias("name"))
    done = cut(done if extension == "txt" else done.join(chapters.select("folder").distinct(), "folder", "left_semi"))
    if not keep_cache:
        at = filesink.qualified(spark, cache)
        done.select("folder").foreachPartition(lambda rows: [filesink.delete_folder(at, r["folder"]) for r in rows] and None)
    return done


def expired(files: DataFrame, days: int, now_ms: int | None = None) -> DataFrame:
    """Of files (name, timestamp in ms, as list_artifacts gives them), those older than so many days."""
    return files.where(F.col("timestamp") < (int(time.time() * 1000) if now_ms is None else now_ms) - days * 86_400_000)
