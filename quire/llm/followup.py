"""Alerts for errors that no sale followed up, as a stateful stream over hash buckets of clients.

An error click opens an obligation of its client, or joins the open one; it stays open for OPEN_US after its latest click. A
sale meanwhile cancels it; else it alerts once the watermark has passed its end. Events come in batches, up to HOLD_US late.

The stream holds one state for each bucket: a dictionary of the open obligations of its clients, and one heap that orders
buffered events and deadlines together. A deadline is not taken out of the heap when a later click moves it or a sale cancels
it; it is seen to be void when it comes up. With each batch every bucket gets a row, the tick, that carries the exact watermark
W: it is how a bucket without events learns that time went on, and no clock or built-in watermark is used. What lies before W
can no longer change, as later events that are older are late, so it is applied, in order.

Rows are condensed before they are shuffled, in the tasks that read them. Of the sales of a client in one slot of time, the
first and the last stay; clicks after the first and up to the last go. That loses nothing: whatever is open at the first sale
ends there, and whatever opens after it ends at the last one at the latest, as a slot is no longer than an obligation lasts.
Equal clicks become one row with their number, and so do all late events of a client. So a hot client costs its bucket two
sales a slot and task, and its clicks outside of them.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .common import fresh_folder, table

BATCHES = 8
#: Hours that all batches span, and hours by which a quarter of the rows each is held back, 0 to 3 times.
SPAN_HOURS, LAG_HOURS = 3648, 80
HOUR_US = 3_600_000_000
HOLD_US, OPEN_US, SLOT_US = 96 * HOUR_US, 24 * HOUR_US, 12 * HOUR_US
START_US = 1_704_067_200_000_000
#: States of the stream. One bucket's open obligations and buffered events fit into a task; more clients need more buckets.
BUCKETS = 256
CLICK, SALE, DEADLINE, TICK, LATE = range(5)
NEVER, ALWAYS = -(2**63), 2**63 - 1
ROW = "bucket int, batch int, w_us long, kind int, client_id long, t_us long, n long"
FOUND = "batch int, client_id long, opened_us long, due_us long, n_rows long"


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    n = F.col(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts.cast("timestamp_ntz")
    whole = F.unix_date(n.cast("date")).cast("long") * 24 * HOUR_US + F.hour(n).cast("long") * HOUR_US + F.minute(n).cast("long") * 60_000_000
    return whole + (F.date_part(F.lit("SECOND"), n) * 1_000_000).cast("long")


def batch_of(arrived: str, id_: str) -> Column:
    """The batch of a row; ids and times of arrival that are null count as id 0 and as the start."""
    hours = F.floor((F.coalesce(epoch_us(arrived), F.lit(START_US)) - START_US) / HOUR_US)
    digits = F.coalesce(F.col(id_), F.lit(0)).cast("long").cast("string").cast("binary")
    h = hours + LAG_HOURS * (F.crc32(digits) % 4)
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor(h * BATCHES / SPAN_HOURS))).cast("int")


def events(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """(batch, kind, client_id, t_us): error clicks, equal rows once, and sales, that have a client and a time."""
    errors = clicks.where("kind = 'error' AND client_id IS NOT NULL AND ts IS NOT NULL").distinct()
    sold = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
    one = errors.select(batch_of("arrived_at", "click_id").alias("batch"), F.lit(CLICK).alias("kind"), F.col("client_id").cast("long"), epoch_us("ts").alias("t_us"))
    return one.unionByName(sold.select(batch_of("arrived_at", "sale_id").alias("batch"), F.lit(SALE).alias("kind"), F.col("client_id").cast("long"), epoch_us("sold_at").alias("t_us")))


def condensed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a batch that have the same effect: late events counted, sales and clicks between sales thinned out, equal clicks
    counted. Ticks stay. Holds for any part of a batch."""
    ticks, rest = rows[rows["kind"] == TICK], rows[rows["kind"] != TICK]
    by = ["bucket", "batch", "w_us", "client_id"]
    late = rest["t_us"] < rest["w_us"]
    counted = rest[late].groupby(by, as_index=False)["n"].sum().assign(kind=LATE, t_us=0)
    rest = rest[~late].assign(slot=lambda x: x["t_us"] // SLOT_US)
    sales = rest[rest["kind"] == SALE].groupby([*by, "slot"], as_index=False)["t_us"].agg(["min", "max"])
    clicks = rest[rest["kind"] == CLICK].merge(sales, on=[*by, "slot"], how="left")
    clicks = clicks[~((clicks["t_us"] > clicks["min"]) & (clicks["t_us"] <= clicks["max"]))]
    clicks = clicks.groupby([*by, "t_us"], as_index=False)["n"].sum().assign(kind=CLICK)
    first = sales[[*by, "min"]].rename(columns={"min": "t_us"})
    last = sales[sales["max"] > sales["min"]][[*by, "max"]].rename(columns={"max": "t_us"})
    kept = [x.assign(kind=SALE, n=1) for x in (first, last)]
    return pd.concat([x for x in (ticks, counted, clicks, *kept) if len(x)] or [rows])[list(rows.columns)]


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pandas(condensed(batch.to_pandas()), schema=batch.schema, preserve_index=False)


def advance(open_: dict[int, list[int]], heap: list[tuple[int, int, int, int]], w: int) -> Iterator[tuple[int, int, int, int]]:
    """Applies what lies before w, in order; gives (client, opened, due, clicks) of each obligation that ran out."""
    while heap and heap[0][0] < w:
        t, kind, client, n = heappop(heap)
        own = open_.get(client)
        if kind == CLICK:
            if own is None:
                own = open_[client] = [t, t, 0]
            own[1], own[2] = t + OPEN_US, own[2] + n
            heappush(heap, (own[1], DEADLINE, client, 0))
        elif kind == SALE:
            open_.pop(client, None)
        elif own is not None and own[1] == t:
            del open_[client]
            yield client, own[0], own[1], own[2]


def _bucket(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of one bucket."""
    open_, heap = pickle.loads(state.get[0]) if state.exists else ({}, [])
    late: Counter[int] = Counter()
    w = batch = None
    for rows in frames:
        w, batch = int(rows["w_us"].iloc[0]), int(rows["batch"].iloc[0])
        new = rows[rows["kind"] <= SALE]
        heap += zip(new["t_us"].tolist(), new["kind"].tolist(), new["client_id"].tolist(), new["n"].tolist(), strict=True)
        for client, n in rows[rows["kind"] == LATE].groupby("client_id")["n"].sum().items():
            late[int(client)] += int(n)
    heapify(heap)
    found = [(batch, *alert) for alert in advance(open_, heap, w)] + [(batch, client, -1, -1, n) for client, n in late.items()]
    state.update((pickle.dumps((open_, heap)),))
    if found:
        yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])


def missing_follow_ups(clicks: DataFrame, sales: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(batch, client_id, opened_us, due_us, n_rows): a row for each alert (first click, end, number of clicks), and one for each
    batch and client with late events (-1, -1, their number).

    clicks: (click_id, ts, arrived_at, client_id, kind); sales: (sale_id, client_id, sold_at, arrived_at); other columns only
    tell equal clicks from others. Clicks of other kinds, and rows without client or time, take no part; rows without a time of
    arrival or id count as id 0 and as arrived at the start. At equal times clicks come before sales, and a sale at the very
    end of an obligation still cancels it. Repeated clicks count once, repeated sales change nothing. Without events there are
    no rows. What is still open after all batches alerts as batch BATCHES.

    The batches are written to the shared folder one after the other, each with its watermark and a tick a bucket; after
    each, the streaming query is started anew on its checkpoint and takes what is there. The driver sees one number a batch.
    A lost executor's tasks are done again from the files and the state in the shared folder.
    """
    spark = clicks.sparkSession
    folder = fresh_folder(spark)
    events(clicks, sales).write.partitionBy("batch").parquet(f"{folder}/events")
    staged = spark.read.schema("kind int, client_id long, t_us long, batch int").parquet(f"{folder}/events")
    latest = {r["batch"]: r["t"] for r in staged.groupBy("batch").agg(F.max("t_us").alias("t")).collect()}
    bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")

    for b in range(BATCHES + 1):
        before = [t for batch, t in latest.items() if batch < b]
        w = ALWAYS if b == BATCHES else max(before) - HOLD_US if before else NEVER
        with_w = lambda df: df.withColumns({"batch": F.lit(b), "w_us": F.lit(w).cast("long")})  # noqa: E731, B023
        own = with_w(staged.where(F.col("batch") == b).withColumns({"bucket": bucket, "n": F.lit(1).cast("long")})).sortWithinPartitions("client_id", "t_us")
        ticks = with_w(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(TICK).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("client_id", "t_us", "n"))).coalesce(1))
        names = [c.split()[0] for c in ROW.split(", ")]
        own.select(names).unionByName(ticks.select(names)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ROW).parquet(f"{folder}/in").mapInArrow(_condense, ROW)
        alerts = stream.groupBy("bucket").applyInPandasWithState(_bucket, FOUND, "kept binary", "append", "NoTimeout")
        query = alerts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(FOUND).parquet(f"{folder}/out")


def op12_missing_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_follow_ups(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


OP12_SQL = f"""
WITH e AS (
  SELECT click_id id, client_id, epoch_us(ts) t, {CLICK} k, arrived_at FROM (SELECT DISTINCT * FROM clicks WHERE kind = 'error') WHERE client_id IS NOT NULL AND ts IS NOT NULL
  UNION ALL
  SELECT sale_id, client_id, epoch_us(sold_at), {SALE}, arrived_at FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
bits AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(coalesce(id, 0)::VARCHAR, '')])),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END) crc FROM e),
b AS (
  SELECT client_id, t, k, greatest(0, least({BATCHES - 1}, floor((floor((coalesce(epoch_us(arrived_at), {START_US}) - {START_US}) / {HOUR_US}) + {LAG_HOURS} * (xor(crc, 4294967295) & 3)) * {BATCHES} / {SPAN_HOURS})))::INT batch FROM bits),
w AS (
  SELECT r.b::INT b, (SELECT max(t) FROM b WHERE batch < r.b) - {HOLD_US} w FROM range(0, {BATCHES}) r(b)),
judged AS (SELECT b.*, coalesce(t < w.w, false) late FROM b JOIN w ON w.b = b.batch),
o AS (
  SELECT client_id, t, k, row_number() OVER p rn, lag(k) OVER p pk, lag(t) OVER p pt, lead(k) OVER p nk, lead(t) OVER p nt
  FROM judged WHERE NOT late WINDOW p AS (PARTITION BY client_id ORDER BY t, k)),
i AS (
  SELECT *, sum(CASE WHEN k = {CLICK} AND pk = {CLICK} AND t <= pt + {OPEN_US} THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY rn) island FROM o),
g AS (
  SELECT client_id, min(t) opened_us, max(t) + {OPEN_US} due_us, count(*) n_rows, arg_max(coalesce(nk, -1), rn) nk, arg_max(coalesce(nt, 0), rn) nt
  FROM i WHERE k = {CLICK} GROUP BY client_id, island)
SELECT coalesce((SELECT min(w.b) FROM w WHERE w.w > g.due_us), {BATCHES})::INT batch, client_id, opened_us, due_us, n_rows FROM g WHERE NOT (nk = {SALE} AND nt <= due_us)
UNION ALL
SELECT batch, client_id, -1, -1, count(*) FROM judged WHERE late GROUP BY batch, client_id
"""
