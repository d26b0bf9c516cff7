"""The sink of whole files: twice-run tasks, failed jobs, other file systems."""

import os

import pytest
from pyarrow import fs as pafs
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.sources import filesink


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def rows(*names, data=b"x"):
    return iter([Row(folder=f, name=n, data=bytearray(data)) for f, n in names])


def test_files_appear_when_the_job_commits(spark, tmp_path):
    at = str(tmp_path / "a b%20c")
    df = spark.range(50).select(F.concat(F.lit("f"), F.col("id") % 3).alias("folder"), F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "UTF-8").alias("data"))
    filesink.write_files(df.repartition(5), at)
    filesink.write_files(df, f"file://{at}")  # again, over the old ones, by a URI
    assert len(files_below(at)) == 50 and open(f"{at}/f1/7.txt", encoding="utf-8").read() == "é" * 7
    filesink.write_files(df.where("id < 2"), at, overwrite=True)
    assert files_below(at) == ["f0/0.txt", "f1/1.txt"]
    filesink.write_files(df.limit(0), at)
    assert len(files_below(at)) == 2


def test_failed_job_leaves_what_was_there(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(20).select("id", F.lit(None).cast("string").alias("folder"), F.concat("id", F.lit(".txt")).alias("name"), F.lit(b"old").alias("data"))
    filesink.write_files(df.where("id = 0"), at)
    broken = df.withColumn("data", F.when(F.col("id") == 19, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"new")))
    twice = df.unionByName(df.where("id = 3"))
    outside = df.withColumn("name", F.lit("../escape.txt"))
    for bad in (broken.repartition(4), twice, outside, df.withColumn("folder", F.lit("a/../../b"))):
        with pytest.raises(Exception):  # noqa: B017
            filesink.write_files(bad, at)
        assert files_below(str(tmp_path)) == ["out/0.txt"] and open(f"{at}/0.txt").read() == "old"


@pytest.mark.parametrize("kind", ["local", "mock"])
def test_task_run_twice_counts_once(tmp_path, kind):
    files = pafs.LocalFileSystem() if kind == "local" else pafs._MockFileSystem()
    root = str(tmp_path) if kind == "local" else "bucket/dir"
    files.create_dir(root, recursive=True)
    writer = filesink.FilesWriter(root, files=files)
    first, again = writer.write(rows(("a", "1"), ("", "2"))), writer.write(rows(("a", "1"), ("", "2"), data=b"y"))
    names = lambda: sorted(f.path[len(root) + 1 :] for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and ".writing-" not in f.path)
    assert first.folder != again.folder and names() == []
    writer.commit([again, None])
    assert names() == ["2", "a/1"] and files.open_input_stream(f"{root}/a/1").read() == b"y"
    assert not [f for f in files.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith(".writing-")]
    other = filesink.FilesWriter(root, files=files)
    other.write(rows(("", "3")))
    other.abort([None])
    assert names() == ["2", "a/1"]
    third = filesink.FilesWriter(root, files=files)
    with pytest.raises(ValueError):
        third.commit([third.write(rows(("", "4"))), third.write(rows(("", "4")))])
    assert names() == ["2", "a/1"]
