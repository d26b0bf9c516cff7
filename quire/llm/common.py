"""What several operators share: words, staging in the shared folder, joins whose broadcast side is counted first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits that bitmap_construct_agg puts into one row; bits for each key of join_wide, and most of them in all (32 MB).
BITMAP, KEY_BITS, MOST_BITS = 8 * 4096, 16, 1 << 28

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(col, UPPER, LOWER)


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))


def word_hashes(text: Column) -> Column:
    """array<bigint>: a 64-bit hash of each word, made in the JVM."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share; a temporary one where none is set, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = made.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(made)
    files.deleteOnExit(made)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here, and lost executors cost nothing.
    The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    folder = fresh_folder(spark)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def at_most(df: DataFrame, rows: int, values: Column | None = None) -> bool:
    """Whether df has no more than so many rows, and no more than so many values (sum of `values`) where rows hold arrays.
    Reads no more rows than it must."""
    counted = df.select((F.lit(0) if values is None else values).alias("v")).limit(rows + 1)
    found = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return found["n"] <= rows and found["v"] <= rows


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 200_000, values: Column | None = None) -> DataFrame:
    """big with small: small is broadcast only when counted to at most `rows` (narrow) rows and array values; beyond that
    Spark joins by shuffle, and adaptive execution splits hot keys of big."""
    return big.join(F.broadcast(small) if at_most(small, rows, values) else small, on, how)


def join_wide(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 200_000) -> DataFrame:
    """join_counted for rows of big that are wide, such as texts (how: inner or left_anti).

    Beyond `rows` rows of small, a bitmap of the hashes of its keys is broadcast in its place, KEY_BITS bits a key. Rows of big
    whose bit is not set have no match and are settled where they are read; only the others go through a shuffle.
    """
    if at_most(small, rows):
        return big.join(F.broadcast(small), on, how)
    keys = small.select(*on).distinct()
    bits = max(BITMAP, min(MOST_BITS, KEY_BITS * keys.count()))
    slot = F.pmod(F.xxhash64(F.lit("slot"), *on), F.lit(bits))
    bucket, place = F.floor(slot / BITMAP), slot % BITMAP
    bitmap = staged(keys.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(place).alias("__bits")), "bitmap")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    held = big.join(F.broadcast(bitmap), bucket == F.col("__bucket"), "left").withColumn("__met", met).drop("__bucket", "__bits")
    joined = held.where("__met").drop("__met").join(small, on, how)
    return joined if how == "inner" else joined.unionByName(held.where("not __met").drop("__met"))
