"""A queue of runs: first come, first served, some at a time, each a Spark job group of its own that can be cancelled."""

from __future__ import annotations

import itertools
import os
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

LOG_LINES = 2000


class Cancelled(Exception):
    """A run was told to stop."""


class Duplicate(Exception):
    """The same source is waiting or running already."""


@dataclass
class Job:
    number: int
    path: str
    state: str = "waiting"  #: waiting, running, done, failed, cancelled
    stage: str = ""
    done: int = 0
    total: int = 0
    error: str = ""
    began: float | None = None
    ended: float | None = None
    log: deque = field(default_factory=lambda: deque(maxlen=LOG_LINES))
    stop: threading.Event = field(default_factory=threading.Event)

    def progress(self, stage: str, done: int = 0, total: int = 0) -> None:
        """Told by a run between its stages; a cancelled one ends here."""
        self.stage, self.done, self.total = stage, done, total
        self.log.append((time.time(), stage, done, total))
        if self.stop.is_set():
            raise Cancelled(self.path)

    @property
    def seconds(self) -> float | None:
        return None if self.began is None else round((self.ended or time.time()) - self.began, 1)


class Jobs:
    """``run`` (a job) does the work, in a thread; Spark does the rest. ``slots`` of them run at a time."""

    def __init__(self, spark: SparkSession, run: Callable[[Job], object], slots: int = 1):
        self.spark, self.run, self.free = spark, run, slots
        self.all: list[Job] = []
        self.results: dict[int, object] = {}
        self._lock, self._numbers, self._threads = threading.RLock(), itertools.count(), []

    def submit(self, path: str) -> Job:
        whole = path if "://" in path else os.path.realpath(path)
        with self._lock:
            if any(j.path == whole and j.state in ("waiting", "running") for j in self.all):
                raise Duplicate(whole)
            job = Job(next(self._numbers), whole)
            self.all.append(job)
            self._next()
        return job

    def cancel(self, job: Job) -> None:
        """A waiting job goes at once, a running one at its next stage; what it has stored stays."""
        with self._lock:
            job.stop.set()
            if job.state == "waiting":
                job.state, job.ended = "cancelled", time.time()
            elif job.state == "running":
                self.spark.sparkContext.cancelJobGroup(self._group(job))

    def get(self, number: int) -> Job | None:
        return next((j for j in self.all if j.number == number), None)

    def wait(self, timeout: float | None = None) -> None:
        while threads := [t for t in self._threads if t.is_alive()]:
            threads[0].join(timeout)
            if timeout is not None:
                return

    @staticmethod
    def _group(job: Job) -> str:
        return f"folio-{job.number}"

    def _next(self) -> None:
        for job in self.all:
            if self.free and job.state == "waiting":
                self.free -= 1
                job.state, job.began = "running", time.time()
                self._threads.append(threading.Thread(target=self._work, args=(job,), daemon=True))
                self._threads[-1].start()

    def _work(self, job: Job) -> None:
        self.spark.sparkContext.setJobGroup(self._group(job), job.path, interruptOnCancel=True)
        try:
            self.results[job.number] = self.run(job)
            state = "done"
        except Cancelled:
            state = "cancelled"
        except Exception as error:
            state, job.error = ("cancelled", "") if job.stop.is_set() else ("failed", str(error)[:2000])
        with self._lock:
            job.state, job.ended = state, time.time()
            self.free += 1
            self._next()
