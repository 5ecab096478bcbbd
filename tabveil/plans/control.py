"""Runs under control: progress and cancelling, jobs, the budget of maps, and the analyses that were handed out.

Spark holds maps as tables that spill, so that no budget is needed for memory; `budget` is there for a caller who wants
a run refused. Nothing here keeps rows: a job is a few numbers on the driver.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabveil.operators import distribution

#: Entries of all maps of a run, bytes of one, share of memory; jobs kept, their age in seconds, seconds between reports, analyses kept.
MOST_ENTRIES, ENTRY_BYTES, MEMORY_SHARE = 32_000_000, 160, 0.2
JOBS_KEPT, JOB_AGE, REPORT_EVERY, ISSUED_KEPT = 20, 30 * 60, 0.1, 16
DONE = {"completed", "failed", "canceled"}


class Canceled(RuntimeError):
    """The caller asked for the run to end."""


class MapBudgetError(RuntimeError):
    """The maps of a run would have more entries than its budget."""


class ProcessControl(Protocol):
    def progress(self, stage: str, share: float) -> None: ...

    def canceled(self) -> bool: ...


def ceiling(memory_bytes: int | None = None) -> int:
    """Entries that the maps of a run may have: 32 million, or a fifth of the memory if that is less."""
    return MOST_ENTRIES if memory_bytes is None else min(MOST_ENTRIES, int(memory_bytes * MEMORY_SHARE) // ENTRY_BYTES)


def entries(df: DataFrame, strategies: dict[str, str]) -> int:
    """Entries of the maps of columns under their strategies: distinct keys, times the entries of one."""
    mapped = [c for c, s in strategies.items() if distribution.ENTRIES[s]]
    if not mapped:
        return 0
    per = F.create_map(*[F.lit(x) for c in mapped for x in (c, distribution.ENTRIES[strategies[c]])])
    return distribution.value_counts(df, mapped).agg(F.coalesce(F.sum(per[F.col("col")]), F.lit(0)).cast("long")).first()[0]


def budget(df: DataFrame, strategies: dict[str, str], most: int | None = None) -> int:
    """The entries, or MapBudgetError where there are more than `most`: a run is refused, never cut short."""
    n, limit = entries(df, strategies), ceiling() if most is None else most
    if n > limit:
        raise MapBudgetError(f"the maps would have {n} entries; {limit} are allowed")
    return n


@dataclass
class Job:
    """What is known of a run. state: queued, running, completed, failed or canceled."""

    id: str
    kind: str
    state: str = "queued"
    stage: str = ""
    share: float = 0.0
    message: str = ""
    updated: float = field(default_factory=time.monotonic)
    stop: threading.Event = field(default_factory=threading.Event, repr=False)


class Jobs:
    """The jobs of a driver: the last 20 that ended within 30 minutes stay known, and one writer runs at a time."""

    def __init__(self, spark: SparkSession | None = None, publish: Callable[[Job], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.publish, self.clock = spark, publish, clock
        self._jobs: OrderedDict[str, Job] = OrderedDict()
        self._lock, self._told = threading.Lock(), {}

    def get(self, job: str) -> Job | None:
        with self._lock:
            self._prune()
            return self._jobs.get(job)

    def all(self) -> list[Job]:
        with self._lock:
            self._prune()
            return list(self._jobs.values())

    def cancel(self, job: str) -> bool:
        """Ends the job's Spark stages; False where it is unknown or over."""
        with self._lock:
            found = self._jobs.get(job)
            if not found or found.state in DONE:
                return False
            found.stop.set()
        if self.spark:
            self.spark.sparkContext.cancelJobGroup(job)
        return True

    @contextmanager
    def run(self, kind: str, writes: bool = True) -> Iterator[Control]:
        """The block is the job. Stages that it starts belong to its group, so that `cancel` reaches them."""
        with self._lock:
            if writes and any(j.state == "running" and j.kind.startswith("write:") for j in self._jobs.values()):
                raise RuntimeError("another run is writing")
            job = Job(uuid.uuid4().hex, f"write:{kind}" if writes else kind, "running", updated=self.clock())
            self._jobs[job.id] = job
        context = self.spark.sparkContext if self.spark else None
        if context:
            context.setJobGroup(job.id, kind, interruptOnCancel=True)
        try:
            yield Control(self, job)
            self._end(job, "canceled" if job.stop.is_set() else "completed")
        except BaseException as e:
            self._end(job, "canceled" if job.stop.is_set() or isinstance(e, Canceled) else "failed", type(e).__name__)
            if job.stop.is_set() and not isinstance(e, Canceled):
                raise Canceled(job.id) from e
            raise
        finally:
            if context:
                for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    context.setLocalProperty(name, None)

    def _end(self, job: Job, state: str, message: str = "") -> None:
        with self._lock:
            job.state, job.message, job.updated = state, message, self.clock()
            self._told.pop(job.id, None)
            self._prune()
        if self.publish:
            self.publish(job)

    def _prune(self) -> None:
        now = self.clock()
        over = [k for k, j in self._jobs.items() if j.state in DONE]
        old = [k for k in over if now - self._jobs[k].updated > JOB_AGE]
        for k in old + [k for k in over if k not in old][: max(0, len(over) - len(old) - JOBS_KEPT)]:
            del self._jobs[k]

    def _report(self, job: Job, stage: str, share: float) -> None:
        now = self.clock()
        with self._lock:
            turned = stage != job.stage
            job.stage, job.share, job.updated = stage, min(max(share, 0.0), 1.0), now
            due = turned or now - self._told.get(job.id, -REPORT_EVERY) >= REPORT_EVERY
            if due:
                self._told[job.id] = now
        if due and self.publish:
            self.publish(job)


class Control:
    """A job's ProcessControl."""

    def __init__(self, jobs: Jobs, job: Job):
        self._jobs, self.job = jobs, job

    def progress(self, stage: str, share: float) -> None:
        if self.job.stop.is_set():
            raise Canceled(self.job.id)
        self._jobs._report(self.job, stage, share)

    def canceled(self) -> bool:
        return self.job.stop.is_set()


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and the count of the rows that an action over it has read: no second pass."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Issued:
    """The last 16 analyses that were handed out: a run takes none that did not come from here."""

    def __init__(self, most: int = ISSUED_KEPT):
        self.most, self._known, self._lock = most, OrderedDict(), threading.Lock()

    def register(self, snapshot: str) -> str:
        key = hashlib.sha256(snapshot.encode()).hexdigest()
        with self._lock:
            self._known.pop(key, None)
            self._known[key] = True
            while len(self._known) > self.most:
                self._known.popitem(last=False)
        return key

    def verify(self, snapshot: str) -> None:
        with self._lock:
            if hashlib.sha256(snapshot.encode()).hexdigest() not in self._known:
                raise ValueError("this analysis was not made here, or is too old")
