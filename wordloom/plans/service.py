"""The job queue as a table of events in a folder, with the verbs of a job service.

One writer at a time appends: Parquet folders have no atomic update, so a claim is only safe
with a single worker process. Readers may be many.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import queue
from wordloom.params import JOB_EVENTS, Params, STAGE_OF
from wordloom.plans.stages import invalidated_from
from wordloom.storage import materialize

#: Files that a job offers for download.
FILES = ("out.mp3", "out.lrc", "timeline.json", "plan.json")


class JobTable:
    """Jobs under ``path``. ``clock`` gives seconds since 1970."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.clock, self._last = spark, path, clock, 0

    def log(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], JOB_EVENTS)
        return self.spark.read.schema(JOB_EVENTS).parquet(self.path)

    def jobs(self) -> DataFrame:
        return queue.current(self.log())

    def _append(self, jobs: DataFrame, kind: str, **values) -> None:
        now = self.clock()
        self._last = max(self._last + 1, int(now * 1_000_000))  # the writer's clock in microseconds, made to rise
        own = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        queue.event(jobs, kind, now, F.lit(self._last), **own).write.mode("append").parquet(self.path)

    def _named(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def get(self, job_id: str) -> DataFrame:
        return self.jobs().filter(F.col("id") == job_id)

    def _status(self, job_id: str) -> str | None:
        row = self.get(job_id).select("status").first()
        return row[0] if row else None

    def create(self, job_id: str, url: str, params: str = "{}", language: str | None = None) -> None:
        """Queue a job. A blank url is an error, a blank language is none."""
        if not url.strip():
            raise ValueError("a url is needed")
        self._append(self._named(job_id), "created", url=url.strip(), params=params, language=(language or "").strip() or None)

    def claim_next(self) -> str | None:
        """Start the oldest queued job."""
        row = queue.claim_next(self.jobs()).select("id").first()
        if row is None:
            return None
        self._append(self._named(row[0]), "claimed")
        return row[0]

    def heartbeat(self, job_id: str, stage: str, progress: float) -> None:
        self._append(self._named(job_id), "heartbeat", stage=stage, progress=float(progress))

    def set_title(self, job_id: str, title: str) -> None:
        self._append(self._named(job_id), "titled", title=title)

    def finish(self, job_id: str, status: str, error: str | None = None, warnings: int = 0) -> None:
        if status not in queue.TERMINAL:
            raise ValueError(f"{status!r} doesn't end a job")
        self._append(self._named(job_id), "finished", status=status, error=error, warnings=warnings)

    def request_cancel(self, job_id: str) -> bool:
        """End a queued job, ask a running one to stop; false if there is nothing to stop."""
        status = self._status(job_id)
        if status == "queued":
            self.finish(job_id, "cancelled")
        elif status == "running":
            self._append(self._named(job_id), "cancel")
        return status in ("queued", "running")

    def cancel_requested(self, job_id: str) -> bool:
        row = self.get(job_id).select("cancel_requested").first()
        return bool(row and row[0])

    def update_params(self, job_id: str, params: str) -> None:
        self._append(self._named(job_id), "params", params=params)

    def retry(self, job_id: str) -> bool:
        """Queue an ended job again; false for others."""
        if self._status(job_id) not in queue.TERMINAL:
            return False
        self._append(self._named(job_id), "requeued")
        return True

    def reap_stale(self, after: float = queue.STALE_SECONDS) -> DataFrame:
        """Queue running jobs without a recent heartbeat again: their ``id``."""
        return self._each(queue.stale(self.jobs(), self.clock(), after), "requeued")

    def purge_older_than(self, days: float) -> DataFrame:
        """Drop jobs that ended and were created so long ago: their ``id``."""
        return self._each(queue.expired(self.jobs(), self.clock(), days), "purged")

    def _each(self, jobs: DataFrame, kind: str) -> DataFrame:
        """Append one event for each of the jobs, which never leave the cluster."""
        chosen = materialize(jobs.select("id"), "chosen")
        if not chosen.isEmpty():
            self._append(chosen, kind)
        return chosen

    def rerender(self, job_id: str, old: Params, **changes) -> tuple[Params, str | None]:
        """Change knobs of a job. Knobs of a stage queue it again, from that stage; the others only need a new plan.

        An unknown job is a LookupError. One that hasn't ended keeps the changed knobs, but needs no new plan
        yet: a RuntimeError.
        """
        status = self._status(job_id)
        if status is None:
            raise LookupError(f"no job {job_id}")
        new = old.overlay(**changes)
        stale = invalidated_from(old, new)
        self.update_params(job_id, to_json(new))
        if stale is None and status not in queue.TERMINAL:
            raise RuntimeError("the job is still running")
        if stale is not None:
            self._append(self._named(job_id), "requeued")
        return new, stale

    def recent(self, limit: int = 50) -> DataFrame:
        return queue.public(queue.recent(self.jobs(), limit), self.clock())

    def stats(self) -> DataFrame:
        return queue.stats(self.jobs())

    def health(self) -> dict:
        """Whether the table can be read, and how many jobs have each status."""
        return {"ok": True, "jobs": {r["status"]: r["n"] for r in self.stats().collect()}}

    def compact(self, path: str) -> None:
        """Write the log without the events of purged jobs to another folder."""
        gone = self.log().filter("kind = 'purged'").select("id").distinct()
        self.log().join(gone, "id", "left_anti").select(*queue.FIELDS).write.parquet(path)


def to_json(p: Params) -> str:
    import dataclasses
    import json

    return json.dumps(dataclasses.asdict(p), sort_keys=True)


def from_json(text: str) -> Params:
    """Parameters from JSON; unknown knobs are ignored, missing ones keep their defaults."""
    import dataclasses
    import json

    known = {f.name for f in dataclasses.fields(Params)}
    return Params(**{k: v for k, v in json.loads(text or "{}").items() if k in known})


def download_name(name: str) -> bool:
    """Whether a job offers a file of this name."""
    return name in FILES


# Fixed value: the name of sound without a usable title.
UNTITLED = "bilingual"


def attachment_name(title: str | None) -> str:
    """File name under which a job's sound is offered: letters, digits, blanks, ``-`` and ``_`` of its title."""
    named = re.sub(r"[^\w -]+", "", title or "").strip(" ")
    return (named or UNTITLED) + ".mp3"


def is_cheap(knob: str) -> bool:
    """Whether a change of the knob leaves all stages valid."""
    return knob not in STAGE_OF
