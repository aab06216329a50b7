"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at . ! ? and line feeds; sentences over ``PART`` words into parts, which begin where a
word's hash is the least of some ``WINDOW`` words in a row, so that a passage inside other words is cut alike: all its
words but the first and last ``WINDOW`` - 1 begin a part in either text or in neither). Parts have ``WINDOW`` words at
most, so 51 words in common that hold one sentence end at most have a span in common. From every sentence a span runs
on until it has ``SENTENCES`` sentences and ``WORDS`` words. Spans are hashed (lower case
A-Z, single spaces) and counted over all documents; of each repeated span all but the first occurrence, by doc_id
and then place, are removed: every sentence that a non-first span covers goes.

Defined cases: null text stays null and has no sentences; texts shorter than one span stay; rows equal in doc_id and
text are one document, all others are documents of their own: those that share a doc_id with another text, and then
those without a doc_id, come last in the order, by a hash of doc_id and text; an empty table gives an empty result; extra
columns are ignored by ``span_report`` and kept by ``dedup_spans``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm.common import LAST, as_bytes, bounded_batches, documents, materialise, owner_key

SENTENCES, WORDS, PART = 3, 20, 16
#: Of any so many words of a long sentence in a row one begins a part.
WINDOW = 8
SENTENCE = re.compile(rb"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(rb"[^\t-\r ]+")


def part_starts(parts: list[bytes]) -> list[int]:
    """Where the parts of a long sentence begin: at the last least hash of each ``WINDOW`` words."""
    out, h, at = [0], [zlib.crc32(p) for p in parts], -1
    for i in range(WINDOW - 1, len(h)):
        if at > i - WINDOW and at >= 0:
            if h[i] > h[at]:
                continue
            at = i
        else:
            at = max(range(i - WINDOW + 1, i + 1), key=lambda j: (-h[j], j))
        if at:
            out.append(at)
    return out


def sentences(text: bytes) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normal form, words) of each sentence or part with words; ends reach to the next start."""
    out = []
    for m in SENTENCE.finditer(text):
        parts = m.group().lower().split()
        if not parts:
            continue
        if len(parts) <= PART:
            out.append((m.start(), m.end(), b" ".join(parts), len(parts)))
            continue
        at = [w.start() for w in WORD.finditer(m.group())]
        cuts = part_starts(parts)
        for i, j in zip(cuts, [*cuts[1:], len(parts)]):
            end = m.start() + at[j] if j < len(parts) else m.end()
            out.append((m.start() + (at[i] if i else 0), end, b" ".join(parts[i:j]), j - i))
    return out


def spans(units: list[tuple[int, int, bytes, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash of 16 bytes) of each span."""
    end, words = 0, 0
    for i in range(len(units)):
        while end < len(units) and (end - i < SENTENCES or words < WORDS):
            words += units[end][3]
            end += 1
        if end - i < SENTENCES or words < WORDS:
            return
        yield i, end - i, xxhash.xxh3_128_digest(b"\x1f".join([u[2] for u in units[i:end]]))
        words -= units[i][3]


SPANS = "__pm_k1 long, __pm_k2 long, __pm_doc long"


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct spans of each row."""
    for b in batches:
        digests, size = [], []
        for text in as_bytes(b.column(1)):
            own = {h for _, _, h in spans(sentences(text))}
            digests.extend(own)
            size.append(len(own))
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        doc = np.repeat(b.column(0).to_numpy(), size)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc)], names=["__pm_k1", "__pm_k2", "__pm_doc"])


def keyed(docs: DataFrame) -> DataFrame:
    """__pm_row (the row) and __pm_doc, a number for each document in their order: its doc_id where that is its own.

    The doc_ids that several texts share are written apart, so that the planner sees their size; mostly there are none.
    """
    doc, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    ends = docs.filter("doc_id is not null").groupBy(doc.alias("__pm_id")).agg(F.min(text).alias("x"), F.max(text).alias("y"))
    shared = materialise(ends.filter("x <> y").select("__pm_id"), "shared-ids")
    held = docs.select(F.struct("*").alias("__pm_row"), owner_key().alias("__pm_doc"), F.xxhash64(doc, "text").alias("__pm_hash"))
    if shared.isEmpty():
        return held.drop("__pm_hash")
    late = F.lit(LAST) - F.lit(1 << 61) - F.pmod(F.col("__pm_hash"), F.lit(1 << 61))
    joined = held.join(shared.withColumn("__pm_shared", F.lit(True)), F.col("__pm_doc") == F.col("__pm_id"), "left")
    return joined.select("__pm_row", F.when(F.col("__pm_shared"), late).otherwise(F.col("__pm_doc")).alias("__pm_doc"))


def removals(held: DataFrame) -> DataFrame:
    """(__pm_doc, __pm_drop: hashes of spans that an earlier document holds); a hot span is counted before it is shuffled."""
    bounded_batches(held.sparkSession)
    rows = materialise(held.select("__pm_doc", "__pm_row.text").mapInArrow(_span_rows, SPANS), "spans")
    key = ["__pm_k1", "__pm_k2"]
    owners = rows.groupBy(*key).agg(F.min("__pm_doc").alias("__pm_owner"), F.max("__pm_doc").alias("__pm_most"))
    # written apart, so that the planner sees its size: it broadcasts few repeated spans and splits a hot one's partition
    repeated = materialise(owners.filter("__pm_owner <> __pm_most").select(*key, "__pm_owner"), "repeated-spans")
    gone = rows.join(repeated, key).filter("__pm_doc <> __pm_owner")
    return gone.groupBy("__pm_doc").agg(F.collect_set(F.struct(*key)).alias("__pm_drop"))


def cut(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int, int]:
    """(text without the sentences of dropped spans and of this text's own repeats, sentences, those that went, their words)."""
    units = sentences(text)
    seen: set[bytes] = set()
    gone = []
    for i, n, h in spans(units):
        if h in drop or h in seen:
            gone.append((i, n))
        seen.add(h)
    if not gone:
        return text, len(units), 0, 0
    out = np.zeros(len(units) + 1, dtype=np.int64)
    for i, n in gone:
        out[i] += 1
        out[i + n] -= 1
    covered = np.cumsum(out)[:-1] > 0
    kept, at = [], 0
    for yes, (start, end, _, _) in zip(covered, units):
        if yes:
            kept.append(text[at:start])
            at = end
    return b"".join([*kept, text[at:]]), len(units), int(covered.sum()), sum(u[3] for u, yes in zip(units, covered) if yes)


def _drop_sets(column: pa.Array) -> Iterator[set[bytes]]:
    for x in column:
        if not x.is_valid:
            yield set()
            continue
        h = np.stack([x.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1).astype("<i8").tobytes()
        yield {h[i : i + 16] for i in range(0, len(h), 16)}


def _with_drops(docs: DataFrame) -> DataFrame:
    held = keyed(docs)
    drops = removals(held)
    return held.join(drops.hint("shuffle_hash"), "__pm_doc", "left").select("__pm_row", "__pm_drop")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_removed_words, kept_sha256."""

    def run(batches):
        for b in batches:
            done = [cut(t, g) for t, g in zip(as_bytes(b.column(1)), _drop_sets(b.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3)), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "n_removed_words", "kept_sha256"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_drops(docs).select("__pm_row.*", "__pm_drop").mapInArrow(run, "doc_id long, n_sentences long, n_removed long, n_removed_words long, kept_sha256 string")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with repeated spans gone from text (n_chars, if there, counted anew)."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            row = b.column(0).flatten()
            texts = [None if null else cut(t, g)[0].decode() for t, null, g in zip(as_bytes(row[at]), row[at].is_null().to_pylist(), _drop_sets(b.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else x for i, x in enumerate(row)], names=names)

    out = _with_drops(docs).mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(documents(spark, sf_dir))
