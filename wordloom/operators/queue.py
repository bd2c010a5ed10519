"""The job queue as an append-only log of events and a view of each job's latest state.

Parquet tables have no row updates, so every change is an event; one writer appends at a
time. ``seq`` orders the events of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.params import JOB_EVENTS

TERMINAL = ["done", "failed", "cancelled"]
STALE_SECONDS = 180.0
FIELDS = [x.split()[0] for x in JOB_EVENTS.split(", ")]


def event(rows: DataFrame, kind: str, at: Column | float, seq: Column, **values: Column) -> DataFrame:
    """Events of one kind for the rows' ``id``, in the shape of the log."""
    kinds = dict(x.split() for x in JOB_EVENTS.split(", "))
    known = {"seq": seq, "id": F.col("id"), "kind": F.lit(kind), "at": at if isinstance(at, Column) else F.lit(float(at)), **values}
    return rows.select(*[known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in FIELDS])


def current(log: DataFrame) -> DataFrame:
    """Each job's state, one row per job that isn't purged.

    Every field is the value of the last event that sets or clears it. A requeued job has no
    start, heartbeat, end, error or cancel request left.
    """
    def last(value: Column, kinds: list[str]) -> Column:
        return F.max_by(F.struct(value.alias("v")), F.when(F.col("kind").isin(kinds), F.col("seq")))["v"]

    at = F.col("at")
    on = lambda *k: F.when(F.col("kind").isin(list(k)), at)
    status = (F.when(F.col("kind").isin("created", "requeued"), "queued").when(F.col("kind") == "claimed", "running")
              .when(F.col("kind") == "finished", F.col("status")))
    progress = (F.when(F.col("kind") == "heartbeat", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress")))
                .when(F.col("kind") == "finished", F.when(F.col("status") == "done", 1.0).otherwise(0.0)).otherwise(0.0))
    seen = log.groupBy("id").agg(
        last(F.col("url"), ["created"]).alias("url"),
        last(F.col("params"), ["created", "params"]).alias("params"),
        last(F.col("language"), ["created"]).alias("language"),
        last(F.col("title"), ["titled"]).alias("title"),
        last(status, ["created", "requeued", "claimed", "finished"]).alias("status"),
        last(F.when(F.col("kind") == "heartbeat", F.col("stage")), ["created", "heartbeat", "requeued"]).alias("stage"),
        last(progress, ["created", "heartbeat", "requeued", "finished"]).alias("progress"),
        last(F.when(F.col("kind") == "finished", F.col("error")), ["created", "claimed", "requeued", "finished"]).alias("error"),
        last(F.coalesce("warnings", F.lit(0)), ["created", "finished"]).alias("warnings"),
        last(at, ["created"]).alias("created_at"),
        last(on("claimed"), ["created", "claimed", "requeued"]).alias("started_at"),
        last(on("finished"), ["created", "requeued", "finished"]).alias("finished_at"),
        last(on("claimed", "heartbeat"), ["created", "claimed", "heartbeat", "requeued"]).alias("heartbeat_at"),
        last(F.col("kind") == "cancel", ["created", "requeued", "cancel"]).alias("cancel_requested"),
        F.max(F.col("kind") == "purged").alias("purged"))
    return seen.filter(~F.col("purged")).drop("purged")


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued job, if any; ties go to the least id."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(1)


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "id").limit(limit)


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cancellations(jobs: DataFrame) -> DataFrame:
    """``id, kind, accepted``: queued jobs end at once, running ones get a request, ended ones neither."""
    ended = F.col("status").isin(TERMINAL)
    return jobs.select("id", F.when(F.col("status") == "queued", "finished").when(~ended, "cancel").alias("kind"), (~ended).alias("accepted"))


def stale(jobs: DataFrame, now: float, after: float = STALE_SECONDS) -> DataFrame:
    """Running jobs whose last heartbeat is older than ``after`` seconds."""
    return jobs.filter((F.col("status") == "running") & (F.coalesce("heartbeat_at", F.lit(0.0)) < F.lit(now - after)))


def expired(jobs: DataFrame, now: float, days: float) -> DataFrame:
    """Ended jobs created more than ``days`` ago."""
    return jobs.filter(F.col("status").isin(TERMINAL) & (F.col("created_at") < F.lit(now - days * 86400)))


def public(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs for display: progress and elapsed time rounded half to even."""
    elapsed = F.when(F.col("started_at").isNull(), 0.0).otherwise(F.coalesce("finished_at", F.lit(now)) - F.col("started_at"))
    return jobs.select("id", "url", "status", "stage", F.bround("progress", 3).alias("progress"), "title", "error", "warnings",
                       F.bround(elapsed, 1).alias("elapsed"), F.col("status").isin(TERMINAL).alias("is_terminal"))
