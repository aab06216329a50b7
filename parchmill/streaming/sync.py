"""Syncs as streams and cycles: a file stream into a Reconciler, timed sweeps, trigger files, activity and heartbeats."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from parchmill.operators.documents import queue
from parchmill.operators.reconcile import Reconciler

ACTIVITY = "kind string, started_at string, finished_at string, ok boolean, summary string, detail string"
HEARTBEAT = "name string, detail string, processed_count long, last_heartbeat string"
#: Seconds between syncs and sweeps; names of the files that ask for a sweep or a rebuild.
SYNC_SECONDS, SWEEP_SECONDS = 300, 3600
SWEEP_FILE, REBUILD_FILE = "reconcile.request", "rebuild.request"


def stream_sync(
    docs: DataFrame, reconciler: Reconciler, checkpoint: str, available_now: bool = True, every: str = f"{SYNC_SECONDS} seconds", lookup: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Each micro-batch is one sync of the newest version of each id; a batch that comes again is metadata only.

    With ``lookup`` (the documents of a frame of ids) each batch also tries the failed documents again that it lacks;
    ``failures.stream_retries`` does so without waiting for a batch. The paged source bounds its batches itself; bound those of
    files where the stream is read (``maxFilesPerTrigger``).
    """
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: reconciler.sync(batch, utc_now(), lookup))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def stream_queue(docs: DataFrame, pre: int, post: int | None, claim: int | None, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Documents of a tag queue as they arrive: those to work on go through ``work``, its rows are appended to ``path``.

    A batch that comes again is written anew under its own number, so results are there once. Without ``every`` what is
    there is worked on and the query ends; ``every`` polls (the usual interval is 15 seconds).
    """

    def run(batch: DataFrame, number: int) -> None:
        work(queue(batch, pre, post, claim)[0]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def told(summary: dict) -> str:
    """Fixed texts: one line about a cycle."""
    if "rebuilt" in summary:
        return "index rebuilt — re-indexing the whole archive"
    if summary.get("aborted"):
        return "sweep aborted: enumeration failed"
    if "pruned" in summary:
        return f"pruned {summary['pruned']} deleted document(s)"
    return f"indexed {summary['indexed']}, {summary['failed']} failed" if summary["failed"] else f"indexed {summary['indexed']} document(s)"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def consume(spark: SparkSession, path: str) -> bool:
    """Whether a trigger file was there; it is deleted. Any file system that Spark knows will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


@dataclass
class Cycles:
    """One call of ``once`` is one cycle: a rebuild if asked for, a sync, and a sweep when due, asked for, or in the first cycle.

    ``source`` gives the documents, and whether all of them could be read. Rows of activity go to ``activity``, a
    Parquet folder. A cycle that fails is recorded and the next one tries again; a sweep that fails stays due.
    """

    reconciler: Reconciler
    source: Callable[[], tuple[DataFrame, bool]]
    activity: str
    triggers: str
    confirm: Callable[[DataFrame], DataFrame] | None = None
    clock: Callable[[], datetime] = field(default=lambda: datetime.now(timezone.utc))
    swept_at: datetime | None = None

    def once(self) -> list[dict]:
        spark, out = self.reconciler.spark, []
        rebuild, asked = (consume(spark, f"{self.triggers}/{f}") for f in (REBUILD_FILE, SWEEP_FILE))
        if rebuild:
            self._record(out, "sync", lambda: (self.reconciler.rebuild(), ({"rebuilt": 1}, True))[1])
        docs, complete = self.source()
        self._record(out, "sync", lambda: (self.reconciler.run(docs, self.clock().isoformat()), True))
        now = self.clock()
        if asked or self.swept_at is None or (now - self.swept_at).total_seconds() >= SWEEP_SECONDS:
            confirmed = self.confirm(docs) if self.confirm else None

            def sweep():
                report = self.reconciler.sweep(docs, complete, confirmed, now.isoformat())
                return report, not report["aborted"]

            if self._record(out, "sweep", sweep):
                self.swept_at = now
        spark.createDataFrame([tuple(r[c.split()[0]] for c in ACTIVITY.split(", ")) for r in out], ACTIVITY).coalesce(1).write.mode("append").parquet(self.activity)
        return out

    def _record(self, out: list[dict], kind: str, job) -> bool:
        started = self.clock().isoformat()
        try:
            summary, ok = job()
            detail = told(summary)
        except Exception as e:  # noqa: BLE001  a cycle that fails must not end the loop
            summary, ok, detail = {}, False, f"{type(e).__name__}: {e}"[:200]
        out.append({"kind": kind, "started_at": started, "finished_at": self.clock().isoformat(), "ok": ok, "summary": json.dumps({k: int(v) for k, v in summary.items()}), "detail": detail})
        return ok


class Heartbeats(StreamingQueryListener):
    """Appends a heartbeat (``HEARTBEAT``) to a Parquet folder whenever a query makes progress, with a count that only grows."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path, self.count = spark, name, path, 0

    def beat(self, detail: str, rows: int = 0) -> None:
        self.count += rows
        self.spark.createDataFrame([(self.name, detail, self.count, utc_now())], HEARTBEAT).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.beat("starting")

    def onQueryProgress(self, event) -> None:
        self.beat("running", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.beat("idle")

    def onQueryTerminated(self, event) -> None:
        pass
