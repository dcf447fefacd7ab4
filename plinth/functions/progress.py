"""How far a running stage has come."""

from __future__ import annotations

import logging
import threading
import time
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Counters:
    """What workers add to; Spark brings it to the driver as tasks end. A task that runs twice counts twice."""

    done: Accumulator[int]
    failed: Accumulator[int]

    def add(self, failed: bool) -> None:
        self.done.add(1)
        if failed:
            self.failed.add(1)


class Progress:
    """Logs ``[i/n] name, k failed`` while what it surrounds runs, when there is something new, and once more at the end.

        with Progress(spark, "relevance", total) as progress:
            write(ask(reports, ..., counters=progress.counters))
    """

    def __init__(self, spark: SparkSession, name: str, total: int | None = None, every: float = 5.0):
        self.name, self.total, self.every = name, total, every
        zero = spark.sparkContext.accumulator
        self.counters = Counters(zero(0), zero(0))
        self._stop, self._shown = threading.Event(), -1

    def show(self) -> None:
        done = self.counters.done.value
        if done != self._shown:
            self._shown = done
            log.info("[%s/%s] %s, %s failed, %.0f s", done, "?" if self.total is None else self.total, self.name, self.counters.failed.value, time.monotonic() - self._began)

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self.show()

    def __enter__(self) -> "Progress":
        self._began = time.monotonic()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self.show()
