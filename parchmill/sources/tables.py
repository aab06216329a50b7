"""The driver's tables in the shape of a document store.

Each stand-in has its DuckDB twin in ``SQL``, which the oracles use as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ["de", "en", "es", "fr"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content, correspondent_id, document_type_id, tag_ids, created, modified, indexed_at."""
    d = read(spark, sf_dir, "documents")
    day = lambda n: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % n).cast("int")), "yyyy-MM-dd'T'00:00:00'+00:00'")
    kind = F.lit(None).cast("bigint")
    for i, lang in enumerate(LANGS, 1):
        kind = F.when(F.col("lang") == lang, F.lit(i).cast("bigint")).otherwise(kind)
    return d.select(
        F.col("doc_id").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title"), F.col("text").alias("content"),
        (F.substring("source", 4, 10).cast("bigint") + 1).alias("correspondent_id"), kind.alias("document_type_id"),
        F.array(F.col("doc_id") % 7, F.col("doc_id") % 11 + 10).alias("tag_ids"), day(2000).alias("created"), day(700).alias("modified"), day(300).alias("indexed_at"),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, name; tag 3 is unknown on purpose."""
    s = read(spark, sf_dir, "documents").select("source").distinct()
    who = s.select(F.lit("correspondent").alias("kind"), (F.substring("source", 4, 10).cast("bigint") + 1).alias("id"), F.col("source").alias("name"))
    rows = [("document_type", i, x) for i, x in enumerate(LANGS, 1)] + [("tag", i, f"tag-{i}") for i in [*range(7), *range(10, 21)] if i != 3]
    return who.unionByName(spark.createDataFrame(rows, "kind string, id long, name string"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, embedding: three vectors for each document."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 3").alias("document_id"), "embedding", "label")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, text: each document as one chunk."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")


SQL = {
    "docs": """docs AS (SELECT doc_id AS id, left(split_part(text, chr(10), 1), 40) AS title, text AS content,
  CAST(substr(source, 4) AS BIGINT) + 1 AS correspondent_id,
  CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END::BIGINT AS document_type_id,
  [doc_id % 7, doc_id % 11 + 10] AS tag_ids,
  strftime(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER), '%Y-%m-%dT00:00:00+00:00') AS created,
  strftime(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%dT00:00:00+00:00') AS modified,
  strftime(DATE '2020-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%dT00:00:00+00:00') AS indexed_at FROM documents)""",
    "taxonomy": """taxonomy AS (SELECT DISTINCT 'correspondent' AS kind, CAST(substr(source, 4) AS BIGINT) + 1 AS id, source AS name FROM documents
  UNION ALL SELECT 'document_type', unnest([1, 2, 3, 4])::BIGINT, unnest(['de', 'en', 'es', 'fr'])
  UNION ALL SELECT 'tag', i, 'tag-' || i FROM range(0, 21) t(i) WHERE i NOT IN (3, 7, 8, 9))""",
    "chunks": "chunks AS (SELECT vec_id AS chunk_id, vec_id // 3 AS document_id, embedding, label FROM embeddings)",
}
