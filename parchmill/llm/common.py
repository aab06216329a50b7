"""What the corpus operators share: scratch tables, bounded Arrow batches, text as bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name: [\x20\x09-\x0D]; bytes.split() and bytes.strip() use the same set.
WS = b" \t\n\x0b\x0c\r"

#: Rows and bytes of one Arrow batch, so that long texts do not gather in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; where that is unset an error, in local mode a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "parchmill-checkpoints")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start at the files, so a lost executor costs no lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes; it only ever lowers them, and they stay so, for plans run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower()
        number = int(now.rstrip("bkmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


#: Order of rows without an id: after all others.
LAST = (1 << 63) - 1


def owner_key() -> Column:
    """The order of documents: doc_id; rows without one come after all others, by a hash of the text, so that they are not one group."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) - F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def text_column() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row dictionaries as Arrow batches of bounded size."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
