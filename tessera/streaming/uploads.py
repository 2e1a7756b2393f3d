"""An upload queue as a stream with state: attempts are kept for each task, failures wait for a timer of their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

MOST, STEP = 3, 5.0  # attempts of a task; seconds of waiting for each attempt made
RESULT = StructType([StructField("id", LongType()), StructField("success", BooleanType()), StructField("attempts", IntegerType()), StructField("error", StringType())])
PENDING = StructType([StructField("path", StringType()), StructField("attempts", IntegerType())])


class Uploads(StatefulProcessor):
    """One task a key. ``send(path, attempt)`` gives an error, or None where it went well.

    A task is tried when it comes and, while it has failed fewer than ``most`` times, again after a wait linear in its attempts; then it is failed for good.
    A task that comes again while it waits is the same task. Tasks wait side by side, so a failure holds up no other.
    """

    def __init__(self, send: Callable[[str | None, int], str | None], most: int = MOST, step: float = STEP) -> None:
        self.send, self.most, self.step = send, most, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        paths = [r.path for r in rows]
        if not self.pending.exists():
            yield from self._tried(key, paths[0], 1, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            path, attempts = self.pending.get()
            yield from self._tried(key, path, attempts + 1, timerValues)

    def _tried(self, key, path: str | None, attempt: int, times) -> Iterator[Row]:
        error = self.send(path, attempt)
        if error is not None and attempt < self.most:
            self.pending.update((path, attempt))
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + int(1000 * self.step * attempt))
            return
        self.pending.clear()
        yield Row(id=key[0], success=error is None, attempts=attempt, error=error)

    def close(self) -> None:
        pass


def uploads(tasks: DataFrame, send: Callable[[str | None, int], str | None], most: int = MOST, step: float = STEP) -> DataFrame:
    """A stream of results (id, success, attempts, error) of a stream of tasks (id, path). State goes with the result, so it is bounded by the tasks that wait.

    It needs the RocksDB state store and a trigger by time: timers keep a query alive, so one with ``availableNow`` does not end. After a stop the checkpoint holds the tasks that wait; a ``send`` that was not yet committed is made again.
    """
    return tasks.groupBy("id").transformWithState(Uploads(send, most, step), RESULT, "Append", "ProcessingTime")


def drained(query: StreamingQuery, seconds: float, poll: float = 0.2) -> bool:
    """Stops a query of ``uploads`` once a batch found no new tasks and no task waits; False if it was stopped because the time was up."""
    end = time.monotonic() + seconds
    seen, quiet = None, False
    while query.isActive and time.monotonic() < end and not quiet:
        last = query.lastProgress
        if last is not None and last["batchId"] != seen:
            seen, waiting = last["batchId"], sum(o["numRowsTotal"] for o in last["stateOperators"])
            quiet = waiting == 0 and last["numInputRows"] == 0
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()
    query.stop()
    return quiet
