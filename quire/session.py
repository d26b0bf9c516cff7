"""Session defaults and table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def local_session(cpus: int | str = "*", app: str = "quire", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, for tests and the benchmark. Clusters bring their own session."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, so that its plan starts there. Without a folder that the cluster names, a local
    session takes a temporary one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt by keys to two tasks a core, 32 at least: a small file can be one row group, whose rows are one task."""
    return df.repartition(max(32, 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)
