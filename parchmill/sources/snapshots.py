"""Versioned Parquet tables with one atomic commit for all of them, written as changes.

A table is a base and changes on top of it. A commit writes only the rows that change, each as a Parquet folder of its
own, and then appends one row (version, folders) to the commit log; that append is the moment the version exists.
Readers take the newest row and keep its folders, so a page and its count agree. A key in a later change replaces all
rows of that key. When a table has ``fanout`` changes, the newest of them are merged as far back as those after a change hold
as many rows as it does, so a row is merged again only each time its change has about doubled; all become part of a new
base once they hold over a quarter of the base's rows. So a small batch never rewrites a table. Only Spark reads and writes, so any file system
that Spark knows will do. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
LOG = "version long, schema_version int, tables string"
#: Share of the base's rows beyond which merged changes become part of a new base.
FOLD = 0.25


class SnapshotStore:
    """Tables by name; ``keys`` names the column by which a table's rows are replaced."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], fanout: int = 8):
        self.spark, self.root, self.keys, self.fanout = spark, root.rstrip("/"), keys, fanout
        spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{self.root}/log")

    def head(self) -> tuple[int, dict]:
        """(version, folders of each table) of the newest commit."""
        row = self.spark.read.schema(LOG).parquet(f"{self.root}/log").orderBy(F.desc("version")).limit(1).collect()
        if not row:
            return 0, {}
        if row[0].schema_version > SCHEMA_VERSION:
            raise ValueError(f"written by a newer version: {row[0].schema_version}")
        tables = json.loads(row[0].tables)
        if row[0].schema_version == 1:  # one folder a table
            tables = {k: {"base": [v, None], "changes": []} for k, v in tables.items()}
        return row[0].version, tables

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        held = (self.head()[1] if at is None else at)[table]
        base = self.spark.read.parquet(held["base"][0])
        if not held["changes"]:
            return base
        newest, rows = self._newest(table, held["changes"])
        return base.join(newest.select(self.keys[table]), self.keys[table], "left_anti").unionByName(rows.filter("not __deleted").select(*base.columns))

    def _newest(self, table: str, changes: list) -> tuple[DataFrame, DataFrame]:
        """(keys with their last change, the rows of that change)."""
        key, every = self.keys[table], None
        for i, (path, _) in enumerate(changes):
            one = self.spark.read.parquet(path).withColumn("__at", F.lit(i))
            every = one if every is None else every.unionByName(one)
        newest = every.groupBy(key).agg(F.max("__at").alias("__at"))
        return newest, every.join(newest, [key, "__at"], "left_semi").drop("__at")

    def _write(self, table: str, version: int, df: DataFrame) -> list:
        path = f"{self.root}/{table}/{version}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return [path, self.spark.read.parquet(path).count()]

    def commit(self, replace: dict[str, DataFrame] | None = None, upsert: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None) -> int:
        """All or nothing: whole tables, rows in place of those with their keys, keys (a column of the key's name) to go."""
        version, tables = self.head()
        version, upsert, delete = version + 1, upsert or {}, delete or {}
        for name, df in (replace or {}).items():
            tables[name] = {"base": self._write(name, version, df), "changes": []}
        for name in upsert.keys() | delete.keys():
            key, old = self.keys[name], self.read(name, tables)
            change = upsert[name].select(*old.columns).withColumn("__deleted", F.lit(False)) if name in upsert else None
            if name in delete:
                gone = delete[name].select(F.col(key).cast(dict(old.dtypes)[key]).alias(key)).distinct()
                gone = gone.select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in old.dtypes], F.lit(True).alias("__deleted"))
                change = gone if change is None else change.unionByName(gone)
            written = self._write(name, version, change)
            if written[1]:
                tables[name] = self._compacted(name, version, {"base": tables[name]["base"], "changes": [*tables[name]["changes"], written]})
        row = [(version, SCHEMA_VERSION, json.dumps(tables, sort_keys=True))]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def _compacted(self, name: str, version: int, held: dict) -> dict:
        base, changes = held["base"], held["changes"]
        if len(changes) < self.fanout:
            return held
        if sum(n for _, n in changes) > FOLD * (base[1] or 0):
            return {"base": self._write(name, version, self.read(name, {name: held})), "changes": []}
        rows = [n for _, n in changes]
        start = next((i for i in range(len(rows) - 1) if rows[i] <= sum(rows[i + 1 :])), len(rows) - 2)
        return {"base": base, "changes": [*changes[:start], self._write(name, version, self._newest(name, changes[start:])[1])]}

    def collect_garbage(self, keep: int = 1) -> int:
        """Remove folders that the newest ``keep`` versions do not use; the number removed. Older pinned reads end."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log").orderBy(F.desc("version")).select("tables").limit(keep).collect()  # ``keep`` rows
        used = {p for r in rows for t in json.loads(r.tables).values() for p, *_ in ([t["base"], *t["changes"]] if isinstance(t, dict) else [[t]])}
        jvm, gone = self.spark._jvm, 0
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table in fs.listStatus(path):
            if table.getPath().getName() == "log":
                continue
            for one in fs.listStatus(table.getPath()):
                if not any(u.endswith(f"/{table.getPath().getName()}/{one.getPath().getName()}") for u in used):
                    gone += fs.delete(one.getPath(), True)
        return gone


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of those with their key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(base: DataFrame, ids: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    return base.join(ids.select(F.col(id_column).alias(key)), key, "left_anti")


def update_columns(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The named columns of matched rows from the patch, others as they are."""
    p = patch.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
