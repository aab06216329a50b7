"""Quality rules: base word rules and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Hashed n-grams (four UTF-8 bytes, white space runs as one space) of all documents give the raw multinomial, those of
trusted documents (label quality 1, not toxic) the target multinomial, both smoothed by one count a bucket. A
document's score is the mean over its n-grams of log(target / raw); it is kept if the score is at least ``THRESHOLD``
and the base rules pass. Raw counts cover all rows; the trusted target may be a sample: with more than ``TRUSTED``
trusted ids, those whose hashed id falls in the matching share are taken.

Defined cases: null, empty or white-space texts have no words and fail the base rules; a text with words but without
an n-gram has score 0; labels that contradict each other count as untrusted; without labels the score is 0 for all;
repeated rows get equal results; an empty table gives an empty result; extra columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.common import as_bytes, bounded_batches, documents, owner_key

BUCKETS = 1 << 15
#: Most labelled documents (about) that the target is counted on: a bounded sample, so that their ids can be broadcast and no text
#: moves; raise it with the labels. (Over all labelled rows the join shuffles every text, 1.15 times the input.)
TRUSTED = 50_000
#: Nats for an n-gram below which a document is rejected.
THRESHOLD = -0.5
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]


def repeat_words(parts: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n = len(parts) - 2
    if n < 2 or len(set(zip(parts, parts[1:], parts[2:]))) == n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(p, len(ids)) for p in parts], dtype=np.int64)
    _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, where, count = np.unique(pair[:-1].astype(np.int64) * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = count[where] >= 2
    covered = np.zeros(len(parts), dtype=bool)
    for i in range(3):
        covered[i : i + n] |= hit
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    parts = text.split()
    chars = sum(map(len, parts)) if text.isascii() else len(b"".join(parts).decode("utf-8", "replace"))
    symbols = sum(text.count(s) for s in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats = repeat_words(parts)
    failed = len(parts) < 50 or 100 * repeats > 50 * len(parts)
    return len(parts), chars, symbols, len(lines) - len(set(lines)), repeats, failed


def grams(text: bytes) -> np.ndarray:
    """Bucket of each n-gram of four bytes."""
    b = np.frombuffer(b" ".join(text.split()), dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, dtype=np.int64)
    key = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """About ``most`` ids at most of documents labelled good and not toxic."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("__pm_doc")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count("quality").alias("n"))
    good = good.filter("__pm_doc is not null and q = 1 and n > 0 and coalesce(t, 0) = 0").select("__pm_doc")
    total = good.count()
    if total > most:
        good = good.filter(F.pmod(F.xxhash64("__pm_doc"), F.lit(1 << 24)) < int((1 << 24) * most / total))
    return good.orderBy(F.xxhash64("__pm_doc"), "__pm_doc").limit(most + most // 4)  # a bound only: the share above takes fewer, and an order that each run has


def fit(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """log(target / raw) of each bucket."""
    bounded_batches(docs.sparkSession)
    trusted = trusted_ids(labels, most).withColumn("__pm_good", F.lit(True))  # bounded by ``most``, so it may be broadcast
    marked = docs.select(owner_key().alias("__pm_doc"), "text").join(F.broadcast(trusted), "__pm_doc", "left").select("text", "__pm_good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text, yes in zip(as_bytes(b.column(0)), b.column(1).is_valid().to_pylist()):
                own = np.bincount(grams(text), minlength=BUCKETS)
                raw += own
                if yes:
                    good += own
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    sums = marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows at most
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for at, r, g in sums:
        raw[at] += r
        good[at] += g
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def score(text: bytes, ratio: np.ndarray) -> float:
    at = grams(text)
    return float(ratio[at].mean()) if len(at) else 0.0


REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The counts of the base rules, the score and the verdict of every row."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                own = base(text)
                s = score(text, ratio.value)
                rows.append((doc, *own, s, not own[-1] and s >= threshold))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = [x.split()[0] for x in REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with their columns as they are."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            kept = [not base(t)[-1] and score(t, ratio.value) >= threshold for t in as_bytes(b.column(at))]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
