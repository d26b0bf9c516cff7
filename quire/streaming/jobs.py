"""Job state: phases, counters, admission and progress, as folds of an event log and as keyed streaming state.

An event: job_id, seq, kind (total, done, failed, phase), current, phase, n.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ["fetching", "downloading", "merging", "done", "failed"]
TERMINAL = ["done", "failed"]
_TAKES = "job_id string, total long, done long, failed long, current string, phase string, seq long"


def is_terminal(phase: Column) -> Column:
    return phase.isin(TERMINAL)


def job_progress(events: DataFrame, job: str, seq: str, done: Column, failed: Column, current: str, phase: Column) -> DataFrame:
    """(job, total, done, failed, current, phase, seq): the state of each job after all its events."""
    return events.groupBy(F.col(job).alias("job")).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("done"),
        F.coalesce(F.sum(failed.cast("long")), F.lit(0)).alias("failed"),
        F.max_by(current, seq).alias("current"),
        F.max_by(phase, F.col(seq)).alias("phase"),
        F.max(seq).alias("seq"),
    )


def active_jobs(states: DataFrame) -> DataFrame:
    """(active, latest): number of jobs that go on, and the one with the highest seq among them."""
    going = ~is_terminal(F.col("phase"))
    return states.agg(F.count_if(going).alias("active"), F.max_by(F.when(going, F.col("job")), F.when(going, F.col("seq"))).alias("latest"))


def with_skipped(events: DataFrame, job: str, order: str, failed: Column) -> DataFrame:
    """events with `skipped`: those of a job after its first failure, which never start."""
    first = events.where(failed).groupBy(F.col(job).alias("__job")).agg(F.min(order).alias("__first"))
    marked = events.join(first, events[job] == F.col("__job"), "left")
    return marked.withColumn("skipped", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__job", "__first")


def admitted(requests: DataFrame, most: int, pool: str | None = None) -> DataFrame:
    """requests (job, started, ended, pool) with `active` (admitted jobs under way when one asks) and `admitted` (active <
    most).

    A job that is turned away is never registered, so it counts for nobody; a job that ended is gone at that time, and a null
    end never comes. Requests of equal time go by job. Each decision depends on those before it, so the requests of a pool
    are one sequence, read in order with a heap of at most `most` ends; pools (all one without a column) go side by side.
    """

    def decide(requested: pa.Table) -> pa.Table:
        rows = requested.sort_by([("started", "ascending"), ("job", "ascending")])
        plain = lambda c: rows[c].cast(pa.int64()) if pa.types.is_timestamp(rows[c].type) else rows[c]
        ends: list = []
        counts = []
        for started, ended in zip(plain("started").to_pylist(), plain("ended").to_pylist(), strict=True):
            while ends and started is not None and ends[0] <= started:
                heapq.heappop(ends)
            counts.append(len(ends))
            if len(ends) < most:
                heapq.heappush(ends, float("inf") if ended is None else ended)
        return rows.select(["job", "started"]).append_column("active", pa.array(counts, pa.int64()))

    kind = requests.schema["job"].dataType.simpleString(), requests.schema["started"].dataType.simpleString()
    pooled = requests.select("job", "started", F.col("ended").cast(requests.schema["started"].dataType).alias("ended"), (F.col(pool) if pool else F.lit(0)).alias("__pool"))
    found = pooled.groupBy("__pool").applyInArrow(lambda t: decide(t), f"job {kind[0]}, started {kind[1]}, active long")
    return found.withColumn("admitted", F.col("active") < most)


def admission_stream(events: DataFrame, most: int) -> DataFrame:
    """Streaming: (pool, job, seq, active, admitted) for each request among events (pool, seq, job, kind: ask or end), decided as
    admitted() does over all of them.

    The state of a pool is its registry: the jobs that go on, `most` at the most. An end frees its job's place, also for
    requests of the same batch that come after it; ends of jobs that were turned away or are gone change nothing. Events are
    taken in order of seq within a batch; a job that asks again while it goes on is turned away.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        going = list(state.get[0]) if state.exists else []
        out = []
        for e in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            if e.kind == "ask":
                fits = len(going) < most and e.job not in going
                out.append((key[0], e.job, int(e.seq), len(going), fits))
                if fits:
                    going.append(e.job)
            elif e.kind == "end" and e.job in going:
                going.remove(e.job)
        state.update((going,))
        if out:
            yield pd.DataFrame(out, columns=["pool", "job", "seq", "active", "admitted"])

    keyed = events.select(F.col("pool").cast("string"), F.col("seq").cast("long"), F.col("job").cast("string"), "kind")
    return keyed.groupBy("pool").applyInPandasWithState(decide, "pool string, job string, seq long, active long, admitted boolean", "going array<string>", "append", "NoTimeout")


def snapshot(states: DataFrame, job: str, wanted: list | None = None) -> DataFrame:
    """The last state of each job (or of those that are wanted), as one that subscribes late is sent first; a job that ended
    is told so. Unknown jobs have no row."""
    rows = states if wanted is None else states.where(F.col(job).isin(wanted))
    last = rows.groupBy(job).agg(F.max_by(F.struct(*[c for c in states.columns if c != job]), "seq").alias("s"))
    return last.select(job, "s.*").withColumn("terminal", is_terminal(F.col("phase")))


def fold(state: dict | None, events: pd.DataFrame) -> dict:
    """State of one job after some more events."""
    s = state or {"total": 0, "done": 0, "failed": 0, "current": "", "phase": PHASES[0], "seq": -1}
    for e in events.sort_values("seq", kind="stable").itertuples(index=False):
        if s["phase"] in TERMINAL or e.seq <= s["seq"]:
            continue
        if e.kind == "total":
            s["total"] = int(e.n)
        elif e.kind in ("done", "failed"):
            s[e.kind] += 1
            s["current"] = e.current or ""
        elif e.phase in PHASES:
            s["phase"] = e.phase
        s["seq"] = int(e.seq)
    return s


def progress_stream(events: DataFrame) -> DataFrame:
    """Streaming: after each batch, the full state of every job that changed. A reader that lags heals with the next row; a
    terminal row is a job's last."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = ["total", "done", "failed", "current", "phase", "seq"]
        old = dict(zip(names, state.get, strict=True)) if state.exists else None
        before = old["seq"] if old else None
        new = fold(dict(old) if old else None, pd.concat(list(batches)))
        state.update(tuple(new[n] for n in names))
        if new["seq"] != before:
            yield pd.DataFrame([{"job_id": key[0], **new}])

    keyed = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "kind", "current", "phase", F.col("n").cast("long").alias("n"))
    return keyed.groupBy("job_id").applyInPandasWithState(update, _TAKES, "total long, done long, failed long, current string, phase string, seq long", "update", "NoTimeout")


def event_payload(states: DataFrame) -> DataFrame:
    """(job, type, payload): the message of each state, `done` and `error` for terminal ones."""
    kind = F.when(F.col("phase") == "done", "done").when(F.col("phase") == "failed", "error").otherwise("progress")
    return states.select("job", kind.alias("type"), F.to_json(F.struct(kind.alias("type"), F.col("done").alias("index"), "total", "failed", "current", "phase")).alias("payload"))


def after_retries(attempts: DataFrame, keys: list[str], retries: int, interval_ms: int) -> DataFrame:
    """(keys..., attempt, ok, error, waited_ms): the outcome of fetches whose attempts (keys..., attempt from 0, ok, error) were
    recorded: the first success within `retries` repeats, or the last failure within them. The pause before repeat n is n intervals."""
    tried = attempts.where(F.col("attempt") <= max(0, retries))
    row = F.struct("attempt", "ok", "error")
    best = tried.groupBy(*keys).agg(F.coalesce(F.min_by(row, F.when(F.col("ok"), F.col("attempt"))), F.max_by(row, "attempt")).alias("r"))
    return best.select(*keys, "r.attempt", F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.error").withColumn("waited_ms", (F.expr("cast(attempt as bigint) * (attempt + 1) div 2") * interval_ms).cast("long"))
