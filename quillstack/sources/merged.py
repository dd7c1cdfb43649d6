"""A stored table with one row a key, into which new rows are merged: keys are in buckets by their hash, only the buckets that
new rows touch are written anew, and a manifest (a row a bucket) says where each one's rows are.

The manifest is switched last.  A merge that fails before leaves the table as it was; its files are not read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import manifest, publish

BUCKETS = 64


def merge(new: DataFrame, path: str, key: str, latest: str | None = None, buckets: int = BUCKETS) -> int:
    """Put the rows of `new` in place of those of their keys; returns how many buckets were written.  Of several new rows of a
    key that of the largest `latest` stays.  Later merges keep the first one's number of buckets."""
    spark = new.sparkSession
    before = manifest(spark, f"{path}/manifest")
    if before is not None:
        buckets = before.first()["buckets"]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rest = F.struct(*(c for c in new.columns if c not in (key, latest)))
    one = new.groupBy(key).agg((F.max_by(rest, latest) if latest else F.first(rest)).alias("r")).select(key, "r.*").withColumn("bucket", bucket)
    to = f"{path}/data/{uuid.uuid4().hex}"
    if before is None:
        one.write.partitionBy("bucket").parquet(to)
        touched = spark.read.parquet(to).select("bucket").distinct()
    else:
        touched = one.select("bucket").distinct()
        ids = [r.bucket for r in touched.collect()]  # no more than there are buckets
        if not ids:
            return 0
        old = read(spark, path, ids)
        kept = old.join(one.select(key), key, "left_anti").withColumn("bucket", bucket)
        # A bucket's rows come together, so it is one file.
        kept.unionByName(one).repartition(len(ids), "bucket").write.partitionBy("bucket").parquet(to)
        touched = spark.createDataFrame([(i,) for i in ids], "bucket int")
    rows = touched.select("bucket", F.lit(to).alias("at"), F.lit(buckets).alias("buckets"))
    if before is not None:
        rows = before.join(touched, "bucket", "left_anti").unionByName(rows)
    n = touched.count()
    publish(rows.coalesce(1), f"{path}/manifest")
    return n


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table, or those of its rows that are in some buckets."""
    rows = manifest(spark, f"{path}/manifest")
    if rows is None:
        raise FileNotFoundError(f"{path}: nothing was merged yet")
    every = rows.collect()  # a row a bucket
    first = spark.read.parquet(every[0]["at"]).drop("bucket").schema
    some = [f"{r['at']}/bucket={r['bucket']}" for r in every if buckets is None or r["bucket"] in buckets]
    return spark.read.schema(first).parquet(*some) if some else spark.createDataFrame([], first)
