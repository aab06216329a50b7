"""Failed documents as keyed state of a stream: counts in a row, retries by timer, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from parchmill.operators.reconcile import MOST_FAILURES, Reconciler
from parchmill.session import SETTINGS
from parchmill.streaming.sync import SYNC_SECONDS, utc_now

RESULTS = "id long, outcome string, cycle string"
EVENTS = "id long, event string, failures int"


class FailureCounts(StatefulProcessor):
    """For each id the failures in a row. Events: failed (a count), retry (its time has come), done (it succeeded), given_up (the fifth in a row).

    A timer runs only while an id has failures, so an id that succeeds or is given up costs no state. A result that comes
    twice (a batch that is run again) has the cycle of one that was counted and is left out.
    """

    def __init__(self, seconds: float = SYNC_SECONDS, most: int = MOST_FAILURES):
        self.millis, self.most = int(seconds * 1000), most

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "failures int, cycle string")

    def _timers(self, due: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failures, last = self.held.get() if self.held.exists() else (0, "")
        for r in sorted(rows, key=lambda r: r["cycle"] or ""):
            cycle = r["cycle"] or ""
            if failures and cycle <= last:
                continue
            failures, last = failures + 1 if r["outcome"] == "FAILED" else 0, cycle
            if not failures or failures >= self.most:
                yield Row(id=key[0], event="given_up" if failures else "done", failures=failures)
                failures = 0
            else:
                yield Row(id=key[0], event="failed", failures=failures)
        if failures:
            self.held.update((failures, last))
            self._timers(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        else:
            self.held.clear()
            self._timers(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)  # should its result never come
            yield Row(id=key[0], event="retry", failures=self.held.get()[0])

    def close(self) -> None:
        pass


def failure_events(results: DataFrame, seconds: float = SYNC_SECONDS, most: int = MOST_FAILURES) -> DataFrame:
    """The stream of events (``EVENTS``) of a stream of results (``RESULTS``). Keyed state lies in RocksDB, for which the session is set."""
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    return results.groupBy("id").transformWithState(FailureCounts(seconds, most), EVENTS, "append", "processingtime")


def stream_retries(results: DataFrame, reconciler: Reconciler, lookup: Callable[[DataFrame], DataFrame], events: str, checkpoint: str, seconds: float = SYNC_SECONDS, every: str | None = None) -> StreamingQuery:
    """Failed documents again when their time has come, whether or not a new version has arrived.

    ``lookup`` gives the documents of a frame of ids; ids that it does not give are gone from the source and leave the
    failures. The reconciler has to write its results where ``results`` reads (``Reconciler.results``), which closes
    the loop. Events are written to ``events``, a folder for each batch, so that the state is asked once.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{events}/batch={number}")
        due = batch.sparkSession.read.schema(EVENTS).parquet(f"{events}/batch={number}").filter("event = 'retry'").select("id").distinct()
        if not due.isEmpty():
            reconciler.retry(due, lookup, utc_now())

    writer = failure_events(results, seconds).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(processingTime=every or f"{max(1, int(seconds))} seconds").start()
