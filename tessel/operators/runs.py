"""Runs of several steps that can be cancelled from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The run was cancelled before its last step had ended."""


class Run:
    """Steps in order, each a function of (spark, what the step before returned).

    All Spark jobs of a step carry the run's tag, so cancel(), from any thread and as often as wanted, ends the jobs that are under way;
    no later step begins, and streams given to watch() stop. A step that publishes its result does so at its end (as a commit of a store
    does), so that after a cancelled run readers see the version before."""

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark, self.tag, self.done = spark, f"{name}-{uuid.uuid4().hex}", 0
        self._asked, self._ended, self._streams, self._lock = threading.Event(), threading.Event(), [], threading.Lock()

    @property
    def cancelled(self) -> bool:
        return self._asked.is_set()

    def watch(self, stream):
        with self._lock:
            self._streams.append(stream)
        if self.cancelled:
            stream.stop()
        return stream

    def cancel(self) -> None:
        if self._asked.is_set():
            return
        self._asked.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        threading.Thread(target=self._again, daemon=True).start()
        with self._lock:
            streams = list(self._streams)
        for s in streams:
            s.stop()

    def _again(self) -> None:
        """A step may begin one job after another: those that begin after cancel() end too."""
        while not self._ended.wait(0.2):
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def start(self, steps: Sequence[Callable], value=None):
        """What the last step returns. Raises Cancelled if the run was cancelled, and what a step raises otherwise."""
        try:
            for step in steps:
                if self.cancelled:
                    raise Cancelled(f"before step {self.done + 1} of {len(steps)}")
                self.spark.sparkContext.addJobTag(self.tag)
                self.spark.sparkContext.setInterruptOnCancel(True)
                try:
                    value = step(self.spark, value)
                except (PySparkException, Py4JError) as e:
                    if self.cancelled:
                        raise Cancelled(f"in step {self.done + 1} of {len(steps)}") from e
                    raise
                finally:
                    self.spark.sparkContext.setInterruptOnCancel(False)
                    self.spark.sparkContext.removeJobTag(self.tag)
                self.done += 1
            return value
        finally:
            self._ended.set()
