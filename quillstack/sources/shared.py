"""The folder that driver and executors share, tables kept in it, and manifests that are switched last."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet made) under spark.checkpoint.dir.  Where that is unset, a temporary folder is set, but only
    if all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: no executor's loss can take it away."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if it has no more than so many rows (they are counted)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a manifest: a write that did not end has left no mark of success."""
    store, p = _store(spark, path)
    if not store.exists(p):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in store.listStatus(p)]
    mark = lambda at: store.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
    return sorted(int(n.removeprefix("v=")) for n, at in names if n.startswith("v=") and n[2:].isdigit() and mark(at))


def publish(manifest: DataFrame, path: str) -> int:
    """Write the next version of the manifest under `path`: from then on it is the one that is read."""
    v = max(versions(manifest.sparkSession, path), default=0) + 1
    manifest.write.mode("overwrite").parquet(f"{path}/v={v}")
    return v


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version, or None before the first."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None
