"""A sink of whole files with commit: rows (folder, name, data) become files below a place that a URI names.

Tasks write below a hidden folder of their job, each attempt in a folder of its own, so a task that runs twice, or dies half
way, never touches a finished file. Only when all tasks have succeeded, the driver moves the files of the attempts that count
into place, side by side; a job that fails leaves nothing. Reading and writing go through the file system of the URI, which
is the one that Spark's readers use for the same URI.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "whole_files"
#: Files that the driver moves side by side.
MOVERS = 16


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a full URI, as Spark's own readers understand it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI; a plain path is one of the machine."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def delete_folder(uri: str, folder: str) -> None:
    files, root = opened(uri)
    if files.get_file_info(f"{root}/{folder}").type == pafs.FileType.Directory:
        files.delete_dir(f"{root}/{folder}")


@dataclass
class Attempt(WriterCommitMessage):
    """Where the files of one task lie until the job commits."""

    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool = False, files: pafs.FileSystem | None = None):
        self.uri, self.overwrite, self.files, self.job = uri, overwrite, files, uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = (self.files, self.uri) if self.files is not None else opened(self.uri)
        root = root.rstrip("/")
        return files, root, f"{root}/.writing-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        files, _, writing = self._place()
        own = f"{writing}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        try:
            for r in iterator:
                if not r["name"] or any(part in (".", "..") for x in (r["folder"], r["name"]) for part in (x or "").split("/")) or "/" in r["name"]:
                    raise ValueError(f"no name of a file: {r['folder']}/{r['name']}")
                at = f"{own}/{r['folder']}" if r["folder"] else own
                files.create_dir(at, recursive=True)
                if files.get_file_info(f"{at}/{r['name']}").type != pafs.FileType.NotFound:
                    raise ValueError(f"two files of one name: {r['folder']}/{r['name']}")
                with files.open_output_stream(f"{at}/{r['name']}") as out:
                    out.write(bytes(r["data"] or b""))
        except BaseException:
            files.delete_dir(own)
            raise
        return Attempt(own)

    def commit(self, messages: list[Attempt | None]) -> None:
        files, root, writing = self._place()
        made = []
        for message in messages:
            if message is not None:
                below = files.get_file_info(pafs.FileSelector(message.folder, recursive=True))
                made += [(f.path, f.path[len(message.folder) + 1 :]) for f in below if f.type == pafs.FileType.File]
        if len({to for _, to in made}) < len(made):
            self.abort(messages)
            raise ValueError("two files of one name")
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if not f.base_name.startswith(".writing-"):
                    files.delete_dir(f.path) if f.type == pafs.FileType.Directory else files.delete_file(f.path)
        for folder in {to.rpartition("/")[0] for _, to in made}:
            files.create_dir(f"{root}/{folder}" if folder else root, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            for done in [pool.submit(files.move, a, f"{root}/{to}") for a, to in made]:
                done.result()
        if files.get_file_info(writing).type == pafs.FileType.Directory:
            files.delete_dir(writing)

    def abort(self, messages: list[Attempt | None]) -> None:
        files, _, writing = self._place()
        if files.get_file_info(writing).type == pafs.FileType.Directory:
            files.delete_dir(writing)


class FilesSource(DataSource):
    """The data source behind write_files()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, folder: Column | None = None, data: Column | None = None, overwrite: bool = False) -> None:
    """Files of df (name, and folder and data unless given) below `path`, in one job that takes effect as a whole. Files of
    equal names replace old ones; overwrite: all that was there goes first. ValueError inside the job if two rows name one
    file or a name is none. Null data makes an empty file; a table without rows makes none."""
    spark = df.sparkSession
    spark.dataSource.register(FilesSource)
    rows = df.select((F.col("folder") if folder is None else folder).cast("string").alias("folder"), F.col("name").cast("string"), (F.col("data") if data is None else data).cast("binary").alias("data"))
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", qualified(spark, path)).save()
