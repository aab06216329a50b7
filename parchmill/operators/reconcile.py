"""Incremental reconciliation: hash gate, outcomes, watermark, failures, deletion sweep."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.quality import is_indexable
from parchmill.functions.text import iso_text, parse_timestamp
from parchmill.operators.keywords import Keywords
from parchmill.operators.library import quick_check
from parchmill.session import materialise
from parchmill.sources.snapshots import SnapshotStore

OVERLAP_SECONDS, MOST_FAILURES = 10, 5


def content_hash(x: Column | str) -> Column:
    return F.sha2(F.col(x) if isinstance(x, str) else x, 256)


def outcomes(incoming: DataFrame, state: DataFrame, embed_key: str = "", error_tag: int | None = None) -> DataFrame:
    """incoming with content_hash and outcome: SKIPPED, METADATA_ONLY (same hash and embedding key) or INDEXED.

    The gate also compares the embedding key (model and width), so a new model does embed again.
    """
    known = state.select(F.col("id"), F.col("content_hash").alias("__hash"), F.col("embed_key").alias("__key"))
    hashed = incoming.withColumn("content_hash", content_hash("content"))
    same = F.col("content_hash").eqNullSafe(F.col("__hash")) & F.col("__key").eqNullSafe(F.lit(embed_key))
    out = F.when(~is_indexable("content", "tag_ids", error_tag), "SKIPPED").when(same, "METADATA_ONLY").otherwise("INDEXED")
    return hashed.join(known, "id", "left").withColumn("outcome", out).drop("__hash", "__key")


def tally(rows: DataFrame) -> DataFrame:
    kinds = ["INDEXED", "METADATA_ONLY", "SKIPPED", "FAILED"]
    return rows.agg(F.count("*").alias("seen"), *[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in kinds])


def since(docs: DataFrame, watermark: str | None) -> DataFrame:
    """Documents modified after the watermark, compared as instants, whatever their offsets; a text that is no time is always read, null never.

    Where ``modified`` is a timestamp the filter is one that a source can apply itself.
    """
    if watermark is None:
        return docs
    if dict(docs.dtypes)["modified"] == "timestamp":
        return docs.filter(F.col("modified") > F.lit(watermark).cast("timestamp"))
    at = parse_timestamp("modified")
    return docs.filter(F.col("modified").isNotNull() & (at.isNull() | (at > parse_timestamp(F.lit(watermark)))))


def with_text_times(docs: DataFrame) -> DataFrame:
    """``modified`` as ISO text, as the store holds it."""
    return docs.withColumn("modified", iso_text(F.col("modified"))) if dict(docs.dtypes)["modified"] == "timestamp" else docs


#: Ids that are asked for by a filter at most; more are joined.
MOST_LISTED = 1000


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids; a short list goes as a filter, which a source can apply itself."""
    few = [r.id for r in ids.select("id").limit(MOST_LISTED + 1).collect()]
    return docs.filter(F.col("id").isin(few)) if len(few) <= MOST_LISTED else docs.join(ids.select("id"), "id", "left_semi")


def next_watermark(page: DataFrame) -> DataFrame:
    """One row: the latest readable ``modified`` less the overlap; null if there is none (the old one then stays)."""
    latest = F.max(parse_timestamp("modified"))
    return page.agg(latest.alias("t")).select(iso_text(F.col("t") - F.make_dt_interval(secs=F.lit(OVERLAP_SECONDS))).alias("watermark"))


def fold_failures(state: DataFrame, results: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(id, failures): failed ids count up, successful ones go, ids not attempted stay, ``gone`` ids go.

    The fifth failure in a row takes an id out, so that a later change of its content begins anew (see ``dead_letters``).
    """
    kept = _counted(state, results).filter(F.coalesce(F.col("failures") < MOST_FAILURES, F.lit(False)))
    return kept if gone is None else kept.join(gone.select("id"), "id", "left_anti")


def _counted(state: DataFrame, results: DataFrame) -> DataFrame:
    new = state.join(results.select("id", (F.col("outcome") == "FAILED").alias("__failed")), "id", "full")
    count = F.coalesce("failures", F.lit(0)) + F.when(F.col("__failed"), 1).otherwise(0)
    return new.filter(F.col("__failed").isNull() | F.col("__failed")).select("id", count.cast("int").alias("failures"))


def dead_letters(state: DataFrame, results: DataFrame) -> DataFrame:
    """(id, failures) of the ids that these results make the fifth failure in a row; they leave the state."""
    return _counted(state, results).filter(F.col("failures") >= MOST_FAILURES)


def retry_ids(state: DataFrame, page: DataFrame) -> DataFrame:
    """Failed ids that the page does not hold."""
    return state.select("id").join(page.select("id"), "id", "left_anti")


def failed_documents(state: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, title, failure_count) by id; a document that was never stored has no title."""
    titles = documents.select(F.col("id").alias("document_id"), "title")
    return state.select(F.col("id").alias("document_id"), F.col("failures").alias("failure_count")).join(titles, "document_id", "left").select("document_id", "title", "failure_count").orderBy("document_id")


def sweep(stored: DataFrame, source: DataFrame, complete: bool, confirmed: DataFrame | None = None) -> DataFrame:
    """ids to delete: stored but not in the source; none if the source was not read whole; ``confirmed`` ids stay."""
    gone = stored.select("id").join(source.select("id"), "id", "left_anti")
    if not complete:
        return gone.limit(0)
    return gone if confirmed is None else gone.join(confirmed.select("id"), "id", "left_anti")


def newest(batch: DataFrame) -> DataFrame:
    """The newest version (by the instant of ``modified``, then its text, then content hash) of each id of a batch."""
    rest = [c for c in batch.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(parse_timestamp("modified"), F.lit(0).cast("timestamp")), F.coalesce("modified", F.lit("")), content_hash(F.coalesce("content", F.lit("")))))
    return batch.groupBy("id").agg(best.alias("__r")).select("id", *[F.col("__r")[c].alias(c) for c in rest]).select(*batch.columns)


KEYS = {"documents": "id", "chunks": "document_id", "failures": "id", "meta": "key", "taxonomy": "kind", **Keywords.KEYS}
WATERMARK, RECONCILED, SWEPT, MODEL = "modified_watermark", "last_reconcile_at", "last_full_sweep_at", "embedding_model"


class Reconciler:
    """Syncs documents into the tables of ``KEYS``; ``meta`` (key, value) holds the watermark, the model and when each job ended.

    What a sync writes is the batch's own rows (see SnapshotStore); the stored documents are read in their narrow columns.
    A keyword index, if given, changes in the same commits as the chunks. ``results`` is a folder to which each cycle
    appends (id, outcome, cycle), for streams that follow.
    """

    def __init__(self, store: SnapshotStore, chunk, embed, embed_key: str, error_tag: int | None = None, keywords: Keywords | None = None, results: str | None = None):
        self.store, self.chunk, self.embed, self.embed_key, self.error_tag, self.keywords, self.results = store, chunk, embed, embed_key, error_tag, keywords, results
        self.spark, self.lock = store.spark, threading.RLock()

    def _no_keywords(self) -> dict[str, DataFrame]:
        return self.keywords.empty() if self.keywords else {}

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.store.read("meta").collect()}  # a handful of rows

    def _meta_rows(self, values: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(values.items()), "key string, value string")

    def _none(self, table: str) -> DataFrame:
        return self.store.read(table).limit(0)

    def check_model(self) -> bool:
        """Wipe the chunks if they were made by another model (or none): vectors of two models cannot be compared. True if so."""
        if self.meta().get(MODEL) == self.embed_key:
            return False
        gone = self._meta_rows({WATERMARK: ""}).select("key")
        self.store.commit(replace={"chunks": self._none("chunks"), **self._no_keywords()}, upsert={"meta": self._meta_rows({MODEL: self.embed_key})}, delete={"meta": gone})
        return True

    def rebuild(self) -> None:
        """Wipe documents, chunks, taxonomy and watermark in one commit; the model stays."""
        self.store.commit(replace={t: self._none(t) for t in ("documents", "chunks", "taxonomy")} | self._no_keywords(), delete={"meta": self._meta_rows({WATERMARK: ""}).select("key")})

    def refresh_taxonomy(self, taxonomy: DataFrame) -> None:
        self.store.commit(replace={"taxonomy": taxonomy.select(*self.store.read("taxonomy").columns)})

    def run(self, source: DataFrame, now: str, taxonomy: DataFrame | None = None) -> dict:
        """A cycle: the taxonomy anew, documents modified since the watermark, and those that failed before.

        The source is read once for the page and, if documents failed, once for these.
        """
        if taxonomy is not None:
            self.refresh_taxonomy(taxonomy)
        return self.sync(since(source, self.meta().get(WATERMARK)), now, lambda ids: of_ids(source, ids))

    def retry(self, ids: DataFrame, lookup: Callable[[DataFrame], DataFrame], now: str = "") -> dict:
        """A cycle without a page: of the ids those that the store holds as failed are tried again."""
        with self.lock:
            return self._sync(None, now, lookup, self.store.read("failures").join(ids.select("id"), "id", "left_semi"))

    def sync(self, page: DataFrame, now: str = "", lookup: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """One commit; the counts of outcomes. Only documents to index reach the chunker and the model, and each only once.

        With ``lookup`` (the documents of a frame of ids) failed documents that the page lacks are tried again; ids that it
        does not give are gone and leave the failures, and if it fails, they stay as they are. Failures count up and go as in
        ``fold_failures``. The watermark follows the page alone, whatever failed; retried documents do not move it, and a
        page without rows or without a readable date leaves it. Cycles that share a reconciler wait for one another.
        """
        with self.lock:
            return self._sync(page, now, lookup, None)

    def _outcomes(self, batch: DataFrame, docs: DataFrame, page: bool) -> DataFrame:
        done = outcomes(newest(with_text_times(batch)), docs, self.embed_key, self.error_tag)
        return materialise(done.withColumn("__page", F.lit(page)), "outcomes")

    def _sync(self, page: DataFrame | None, now: str, lookup, due: DataFrame | None) -> dict:
        at = self.store.head()[1]
        docs, chunks, failures = (self.store.read(t, at) for t in ("documents", "chunks", "failures"))
        done, gone = None if page is None else self._outcomes(page, docs, True), None
        due = failures if due is None else due
        ids = None if lookup is None else materialise(due.select("id") if done is None else retry_ids(due, done), "retry-ids")
        if ids is not None and not ids.isEmpty():
            try:
                retry = self._outcomes(lookup(ids), docs, False)
                gone = ids.join(retry.select("id"), "id", "left_anti")
                done = retry if done is None else done.unionByName(retry.select(*done.columns))
            except Exception:  # noqa: BLE001  the source is foreign; its failed documents wait for the next cycle
                pass
        if done is None:
            return dict.fromkeys(("seen", "indexed", "metadata_only", "skipped", "failed", "given_up"), 0)
        todo = done.filter("outcome = 'INDEXED'")
        made = materialise(self.embed(self.chunk(todo)), "embedded")  # written, so that no lost executor asks the model again
        failed = materialise(made.filter("error is not null").select(F.col("document_id").alias("id")).distinct(), "failed")  # few, so the texts need not be shuffled
        verdict = materialise(done.select("id", "outcome", "__page", "modified").join(failed.withColumn("__f", F.lit(True)), "id", "left").withColumn("outcome", F.when(F.col("__f"), "FAILED").otherwise(F.col("outcome"))).drop("__f"), "verdicts")
        good = verdict.filter("outcome in ('INDEXED', 'METADATA_ONLY')").select("id", F.col("outcome").alias("verdict"))
        size = made.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("new_count"))
        held = docs.select("id", F.col("chunk_count").alias("old_count"))
        count = F.when(F.col("verdict") == "INDEXED", F.coalesce("new_count", F.lit(0))).otherwise(F.coalesce("old_count", F.lit(0))).cast("int")
        rows = done.join(good, "id").join(size, "id", "left").join(held, "id", "left").withColumns({"chunk_count": count, "embed_key": F.lit(self.embed_key)})
        fresh = made.filter("document_id is not null").join(failed.select(F.col("id").alias("document_id")), "document_id", "left_anti")  # made of documents to index alone
        emptied = good.filter("verdict = 'INDEXED'").select(F.col("id").alias("document_id"))
        report = tally(verdict).first().asDict() | {"given_up": dead_letters(failures, verdict).count()}
        values = {RECONCILED: now} if now else {}
        if report["seen"] and (mark := next_watermark(verdict.filter("__page")).first().watermark):
            values[WATERMARK] = mark
        meta = {"meta": self._meta_rows(values)} if values else {}
        words = self.keywords.change(fresh, emptied, at) if self.keywords else {}
        version = self.store.commit(replace={"failures": fold_failures(failures, verdict, gone)}, upsert={"documents": rows, "chunks": fresh.select(*chunks.columns), **meta, **words}, delete={"chunks": emptied})
        if self.keywords:
            self.keywords.merge()
        if self.results:
            verdict.select("id", "outcome", F.lit(f"{version:015d}").alias("cycle")).write.mode("append").parquet(self.results)
        return report

    def sweep(self, source: DataFrame, complete: bool, confirmed: DataFrame | None = None, now: str = "") -> dict:
        """Documents gone from the source, with their chunks; an incomplete source deletes nothing and aborts."""
        with self.lock:
            return self._sweep(source, complete, confirmed, now)

    def _sweep(self, source: DataFrame, complete: bool, confirmed: DataFrame | None, now: str) -> dict:
        at = self.store.head()[1]
        docs = self.store.read("documents", at)
        if not complete:
            return {"pruned": 0, "aborted": True, "candidates": 0}
        candidates = sweep(docs, source, complete).count()
        gone = materialise(sweep(docs, source, complete, confirmed), "swept")
        n = gone.count()
        meta = {"meta": self._meta_rows({SWEPT: now})} if now else {}
        owners = gone.select(F.col("id").alias("document_id"))
        words = self.keywords.change(None, owners, at) if self.keywords and n else {}
        if n or meta:
            self.store.commit(upsert=meta | words, delete={"documents": gone, "chunks": owners} if n else {})
        return {"pruned": n, "aborted": False, "candidates": candidates}

    def health(self) -> tuple[str, str]:
        """(ok, ''), (index-not-ready, reason) or (index-corrupt, reason)."""
        tables = self.store.head()[1]
        if not {"documents", "chunks", "meta"} <= tables.keys():
            return "index-not-ready", "schema_missing"
        if not self.meta().get(RECONCILED):
            return "index-not-ready", "never_reconciled"
        bad = quick_check(self.store.read("documents", tables), self.store.read("chunks", tables)).filter("n > 0").limit(1).count()
        return ("index-corrupt", "quick_check_failed") if bad else ("ok", "")
