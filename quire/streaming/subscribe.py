"""Live progress of jobs for many readers: a table of states that a stream keeps, and what each reader gets of it.

The stream writes the states that changed in each of its batches to a folder of that batch, by foreachBatch; a batch that is
run again writes the same folder anew. Every COMPACT batches the last state of each job is written as a snapshot, so a new
reader never reads the whole log. A reader gets its job's last state first, then the later ones, up to the one that ends the
job. What a reader has missed beyond the capacity of its channel is left out, and it is told so: states are whole, so the next
one heals it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import jobs

COMPACT = 20
CAPACITY = 64
STATE = "job_id string, total long, done long, failed long, current string, phase string, seq long"
FIELDS = [c.split()[0] for c in STATE.split(", ")]


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches of the snapshots below a folder that were written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshots/upto=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{STATE}, batch long").parquet(f"{folder}/log")


def last_states(states: DataFrame) -> DataFrame:
    """The last state of each job, of states (job_id, batch, seq, ...)."""
    rest = F.struct(*[c for c in states.columns if c != "job_id"])
    return states.groupBy("job_id").agg(F.max_by(rest, F.struct("seq", "batch")).alias("s")).select("job_id", "s.*")


def states_at(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """(job_id, total, ..., seq, batch): the last state of each job after a batch (all there are), from the newest snapshot that is
    not later and the batches after it."""
    log = _log(spark, folder)
    log = log if batch is None else log.where(F.col("batch") <= batch)
    usable = [v for v in _versions(spark, folder) if batch is None or v <= batch]
    if not usable:
        return last_states(log)
    base = spark.read.schema(f"{STATE}, batch long").parquet(f"{folder}/snapshots/upto={usable[-1]}")
    return last_states(base.unionByName(log.where(F.col("batch") > usable[-1])))


def keep_states(events: DataFrame, folder: str, compact: int = COMPACT, once: bool = False) -> StreamingQuery:
    """Starts the stream that keeps the states of jobs below `folder`, from streamed events as jobs.progress_stream() takes them.
    once: takes what is there and ends."""
    spark = events.sparkSession
    spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.select(FIELDS).write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")
        if (batch + 1) % compact == 0:
            states_at(changed.sparkSession, folder, batch).write.mode("overwrite").parquet(f"{folder}/snapshots/upto={batch}")

    writer = jobs.progress_stream(events).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep)
    return (writer.trigger(availableNow=True) if once else writer).start()


def messages(spark: SparkSession, folder: str, readers: DataFrame, upto: int, capacity: int = CAPACITY) -> DataFrame:
    """(reader, pos, kind, job_id, total, ..., seq): what readers (reader, job_id, joined, read) get when they read now, up to batch
    `upto`.

    A new reader (null `read`) gets the last state of its job after batch `joined` (kind snapshot), then, as one that has read
    up to batch `read`, the later ones (progress). The state that ends a job has kind done or error and is the last; who
    has read it gets nothing more. If more than `capacity` later states wait, the oldest are left out and a row of kind lagged,
    without a state, stands in their place. A null job_id means the job that was under way last when the reader joined; a job
    that is not known yet gives nothing. Readers meet states by an equal join on the job.
    """
    log = _log(spark, folder).where(F.col("batch") <= upto)
    kind = F.when(F.col("phase") == "done", "done").when(F.col("phase") == "failed", "error")
    asked = readers.select("reader", "job_id", F.col("joined").cast("long"), F.col("read").cast("long"))
    named = asked.where("job_id IS NOT NULL")
    open_ = asked.where("job_id IS NULL").drop("job_id")
    joined = [r["joined"] for r in open_.select("joined").distinct().collect()]
    for at in joined:  # readers of equal time share one answer
        going = states_at(spark, folder, at).where(~jobs.is_terminal(F.col("phase"))).agg(F.max_by("job_id", F.struct("batch", "seq", "job_id")).alias("job_id"))
        named = named.unionByName(open_.where(F.col("joined") == at).join(F.broadcast(going)).select("reader", "job_id", "joined", "read"))  # one row
    met = named.where("job_id IS NOT NULL").join(log, "job_id")
    old = met.where("batch <= coalesce(read, joined)")
    last = old.groupBy("reader", "job_id", "read").agg(F.max_by(F.struct(*FIELDS[1:], "batch"), F.struct("batch", "seq")).alias("s")).select("reader", "job_id", "read", "s.*")
    first = last.where("read IS NULL").select("reader", F.lit(0).cast("long").alias("__at"), F.coalesce(kind, F.lit("snapshot")).alias("kind"), *FIELDS)
    over = last.where(jobs.is_terminal(F.col("phase"))).select("reader").distinct()
    new = met.where("batch > coalesce(read, joined)").join(over, "reader", "left_anti")
    behind = new.withColumn("__left", F.row_number().over(W.partitionBy("reader").orderBy(F.col("batch").desc(), F.col("seq").desc())))
    later = behind.where(F.col("__left") <= capacity).select("reader", (F.col("batch") + 2).alias("__at"), F.coalesce(kind, F.lit("progress")).alias("kind"), *FIELDS)
    lagged = behind.where(F.col("__left") == capacity + 1).select("reader", F.lit(1).cast("long").alias("__at"), F.lit("lagged").alias("kind"), "job_id", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STATE.split(", ")[1:])))
    every = first.unionByName(later).unionByName(lagged)
    pos = F.row_number().over(W.partitionBy("reader").orderBy("__at", F.col("seq").asc_nulls_first()))
    return every.select("reader", (pos - 1).alias("pos"), "kind", *FIELDS)
