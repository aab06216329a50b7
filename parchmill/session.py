"""A Spark session with the settings this library expects, and what its operators share: scratch tables, Arrow bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the sources and streams need of a session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Rows and bytes of one Arrow batch at most, so that long texts or images do not gather in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, filters for Python sources, keyed state in RocksDB; everything else is the cluster's choice."""
    b = SparkSession.builder.appName("parchmill").config(map=SETTINGS)
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes; it only ever lowers them, and they stay so."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower()
        number = int(now.rstrip("bkmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/parchmill-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so that a lost executor costs no lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """df with a gapless number from 0 in the order given: a range sort, counts of its parts, and a number within each part.

    Nothing is gathered in one task but one row for each part.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(column, (F.col("__before") + F.col("__own") - 1).cast("bigint")).drop("__part", "__own", "__before")
