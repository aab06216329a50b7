"""Line dedup by levelled sorted runs of line hashes.

``LineRuns`` keeps runs of (line hash, owning doc_id), each bucketed and sorted by hash. A batch of documents
merge-joins the runs without moving them, drops lines whose owner is an earlier document, and adds its own new
hashes as a run of level 0; when a level holds ``fanout`` runs they are compacted into one run of the next level.
Batches must come in ascending doc_id order, so the owner is the smallest doc_id that holds the line.

Defined cases: null or empty text is one empty line, kept; lines whose key is under ``min_chars`` code points stay;
rows with a null doc_id are documents by their text and come last (see ``owner_key``); repeated rows get equal results; an empty table
gives an empty result. Extra columns are ignored by ``line_report`` and kept by ``dedup_lines``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm.common import WS, as_bytes, bounded_batches, documents, materialise, owner_key, scratch_dir

KEYS = "__pm_k1 long, __pm_k2 long, __pm_doc long"


def line_key(line: bytes) -> bytes:
    return line.strip(WS).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least min_chars code points; bytes that continue a code point do not count."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars


def _key_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, docs = [], []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                own = {xxhash.xxh3_128_digest(k) for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}
                digests.extend(own)
                docs.append((doc, len(own)))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            doc = np.repeat(np.array([d for d, _ in docs], dtype=np.int64), [n for _, n in docs])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc)], names=["__pm_k1", "__pm_k2", "__pm_doc"])

    return run


class LineRuns:
    """Levels of runs; each run is a bucketed table sorted by hash in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        """Newest first; the hashes of two runs are disjoint."""
        return [self.spark.table(t).filter("__pm_new").select("__pm_k1", "__pm_k2", "__pm_owner") for level in self.levels for t in reversed(level)]

    def _write(self, df: DataFrame) -> str:
        name = f"pm_line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "__pm_k1", "__pm_k2").sortBy("__pm_k1", "__pm_k2").option("path", scratch_dir(self.spark, name)).saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of (hash, doc) rows; returns the hash and doc of each line to drop."""
        first = keys.groupBy("__pm_k1", "__pm_k2").agg(F.min("__pm_doc").alias("__pm_owner"), F.max("__pm_doc").alias("__pm_most"))
        prior = F.lit(None).cast("long")
        for i, run in enumerate(self.runs()):
            first = first.join(run.withColumnRenamed("__pm_owner", f"__pm_prior{i}"), ["__pm_k1", "__pm_k2"], "left")
            prior = F.coalesce(prior, F.col(f"__pm_prior{i}"))
        seen = first.select(
            "__pm_k1", "__pm_k2",
            F.coalesce(prior, F.col("__pm_owner")).alias("__pm_owner"),
            prior.isNull().alias("__pm_new"),
            (prior.isNotNull() | (F.col("__pm_most") > F.col("__pm_owner"))).alias("__pm_dup"),
        )
        name = self._write(seen)
        # written apart, so that the planner sees its size: it broadcasts few repeated lines and splits a hot one's partition
        dup = materialise(self.spark.table(name).filter("__pm_dup").select("__pm_k1", "__pm_k2", "__pm_owner"), "repeated-lines")
        drops = materialise(keys.join(dup, ["__pm_k1", "__pm_k2"]).filter("__pm_doc <> __pm_owner").select("__pm_doc", "__pm_k1", "__pm_k2"), "line-drops")
        self.levels = [[*(self.levels or [[]])[0], name], *self.levels[1:]]
        self._compact()
        return drops

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Take the runs out of the catalogue; their files stay below the checkpoint folder, as all scratch tables do."""
        for t in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                new = None
                for t in level:
                    run = self.spark.table(t).filter("__pm_new")
                    new = run if new is None else new.unionByName(run)
                merged = self._write(new.withColumn("__pm_dup", F.lit(False)))
                for t in level:
                    self.spark.sql(f"DROP TABLE IF EXISTS {t}")
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)


def line_drops(docs: DataFrame, min_chars: int = 10, n_batches: int = 4, fanout: int = 3) -> DataFrame:
    """(__pm_doc, __pm_drop: hashes of the lines that the document loses), over doc_id ranges added batch by batch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keys = docs.select(owner_key().alias("__pm_doc"), F.col("text")).mapInArrow(_key_rows(min_chars), KEYS)
    shares = [i / n_batches for i in range(1, n_batches)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000)).first()[0] if shares else None
    cuts = sorted(set(found or []))
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.when(F.col("__pm_doc") > int(c), 1).otherwise(0)
    path = scratch_dir(spark, "line-keys")
    keys.withColumn("__pm_batch", batch).write.partitionBy("__pm_batch").parquet(path)
    read = spark.read.schema(f"{KEYS}, __pm_batch int").parquet(path)
    drops = None
    with LineRuns(spark, fanout) as runs:
        for i in range(len(cuts) + 1):
            one = runs.add(read.filter(F.col("__pm_batch") == i).drop("__pm_batch"))
            drops = one if drops is None else drops.unionByName(one)
    return drops.groupBy("__pm_doc").agg(F.collect_list(F.struct("__pm_k1", "__pm_k2")).alias("__pm_drop"))


def _split(text: bytes, drop: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and xxhash.xxh3_128_digest(k) in drop)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _drop_sets(column: pa.Array) -> Iterator[set[bytes]]:
    for x in column:
        if not x.is_valid:
            yield set()
            continue
        s = x.values
        h = np.stack([s.field(0).to_numpy(zero_copy_only=False), s.field(1).to_numpy(zero_copy_only=False)], axis=1).astype("<i8").tobytes()
        yield {h[i : i + 16] for i in range(0, len(h), 16)}


def _with_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    held = docs.select(F.struct("*").alias("__pm_row"), owner_key().alias("__pm_doc"))
    return held.join(drops.hint("shuffle_hash"), "__pm_doc", "left").select("__pm_row", "__pm_drop")


def line_report(docs: DataFrame, min_chars: int = 10, n_batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, drop in zip(as_bytes(b.column(1)), _drop_sets(b.column(2))):
                kept, lines, lost = _split(text, drop, min_chars)
                n.append(lines), gone.append(lost), sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_drops(docs, line_drops(docs, min_chars, n_batches)).select("__pm_row.*", "__pm_drop").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = 10, n_batches: int = 4) -> DataFrame:
    """docs with the repeated lines gone from text (and n_chars, if there, counted anew); a null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = []
            row = b.column(0).flatten()
            for text, null, drop in zip(as_bytes(row[at]), row[at].is_null().to_pylist(), _drop_sets(b.column(1))):
                out.append(None if null else _split(text, drop, min_chars)[0].decode())
            cols = [pa.array(out, pa.string()) if i == at else x for i, x in enumerate(row)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = _with_drops(docs, line_drops(docs.select("doc_id", "text"), min_chars, n_batches)).mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))
