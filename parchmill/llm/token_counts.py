"""Token counts through a digest cache.

Texts are joined by content digest (SHA-256 of the normalised content: null as empty) and tokenizer-version digest to
stored counts. Of the misses one row for each distinct digest is encoded and appended to the cache; then every
document gets its count from the cache. Only digests are grouped; texts move once, by doc_id, which no hot digest
can skew. The counts asked for are written apart, so that a hot digest's documents can be split when they fetch theirs.

The tokenizer-version digest covers what encodes: the vocabulary file, the rank file made of it, and both libraries.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and copies are encoded once and each get
the count; null doc_ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import tokens
from parchmill.llm.common import as_bytes, bounded_batches, documents, materialise, scratch_dir, text_column

#: Digests that a task remembers at most, to encode repeated rows once.
REMEMBERED = 100_000
CACHE = "content_digest string, tokenizer_digest string, n_bytes long, n_tokens long"


class DigestCache:
    """Counts by (content digest, tokenizer digest): a Parquet folder that is only appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)

    def read(self, tokenizer_digest: str) -> DataFrame:
        stored = self.spark.read.schema(CACHE).parquet(self.path).filter(F.col("tokenizer_digest") == tokenizer_digest)
        return stored.groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame) -> None:
        counted.write.mode("append").parquet(self.path)


def token_counts(docs: DataFrame, vocabulary: str, ranks: str, cache: DigestCache, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; distinct texts that the cache lacks are encoded and appended."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokens.version_digest(vocabulary, ranks)
    doc, text = F.col("doc_id").cast("long"), text_column()
    keys = materialise(docs.select(doc.alias("doc_id"), F.sha2(text, 256).alias("content_digest"), F.octet_length(text).cast("long").alias("n_bytes")), "content-digests")
    one = keys.groupBy("content_digest").agg(F.min("doc_id").alias("__pm_doc"))
    misses = one.join(cache.read(version), "content_digest", "left_anti").withColumnRenamed("content_digest", "__pm_digest")
    found = docs.select(doc.alias("doc_id"), text.alias("text")).join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__pm_doc")) & (F.sha2("text", 256) == F.col("__pm_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # repeated rows share a doc_id and so a task; what is forgotten is encoded and stored once more
        for b in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            new = [d not in seen and not seen.add(d) for d in b.column(0).to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            texts = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([version] * len(texts), pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(tokens.counts(texts, vocabulary, ranks), pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_bytes", "n_tokens"],
            )

    cache.append(found.select("__pm_digest", "text").mapInArrow(run, CACHE))
    counts = materialise(cache.read(version).join(one.select("content_digest"), "content_digest", "left_semi"), "token-counts")
    out = keys.join(counts, "content_digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one, so that every call counts all its documents."""
    import public_tokenizers

    cache = DigestCache(spark, scratch_dir(spark, "token-cache"))
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), cache)
