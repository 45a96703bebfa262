"""Generations of a running question, and state kept by key over a stream."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F

T = TypeVar("T")


class Generations:
    """Runs one question at a time: a newer one stops the jobs of the older, whose answer is dropped even if it is there already."""

    def __init__(self, spark: SparkSession):
        self.spark, self.generation, self._lock = spark, 0, threading.Lock()
        self._name, self._futures = f"generation-{uuid.uuid4().hex}", {}

    def _tag(self, generation: int) -> str:
        return f"{self._name}-{generation}"

    def ask(self, work: Callable[[], T]) -> Future[T]:
        """Run work in a thread; its future ends with CancelledError if a newer question or cancel comes before its answer is taken in."""
        with self._lock:
            self._stop()
            self.generation += 1
            mine, future = self.generation, Future()
            self._futures[mine] = future

        def run() -> None:
            sc = self.spark.sparkContext
            sc.addJobTag(self._tag(mine))
            try:
                answer, error = work(), None
            except Exception as e:
                answer, error = None, e
            finally:
                sc.removeJobTag(self._tag(mine))
            with self._lock:
                if future.done():
                    return
                del self._futures[mine]
                future.set_exception(error) if error is not None else future.set_result(answer)

        InheritableThread(target=run, daemon=True).start()
        return future

    def cancel(self) -> None:
        """Stop the running question, if there is one."""
        with self._lock:
            self._stop()

    def _stop(self) -> None:
        for generation, future in list(self._futures.items()):
            self.spark.sparkContext.cancelJobsWithTag(self._tag(generation))
            future.set_exception(CancelledError(f"generation {generation} is over"))
            del self._futures[generation]


def last_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, rest of the columns) of each key's last row in an order, over a stream or a table.

    Over a stream it is state by key, combined before the shuffle; use output mode update. Late rows change nothing,
    and a replayed batch gives what it gave before.
    """
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
