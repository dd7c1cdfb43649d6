"""A vector index kept as tables: inverted lists as Parquet partitioned by the list's number, and a manifest of shards.

A shard's content hash says whether its rows have changed.  A refresh writes the rows of new and changed shards only, as
one more generation of files, and then switches the manifest; rows of shards that changed or went are in older
generations still, and are not read, for the manifest names each shard's generation.  When there are over `MOST_GENERATIONS`
all shards are written anew.  A search reads the lists that its probes name, by partition pruning."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.layout import LIST_ROWS, MOST_LISTS
from ..sources.shared import few, manifest, publish
from .vector import dot, nearest

#: Rows that the lists' centres are fitted on, at most (those of the smallest hashes), and generations that are kept.
SAMPLE, MOST_GENERATIONS = 1 << 16, 16
#: Shards of a manifest, and probes, that are broadcast at most.
BROADCAST_ROWS = 100_000


def _hashes(vectors: DataFrame, shard: str) -> DataFrame:
    """(shard, rows, hash): a hash of each shard's rows in whatever order."""
    row = F.xxhash64(*sorted(c for c in vectors.columns if c != shard))
    both = F.concat_ws("-", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(row, F.lit(1))).cast("string"))
    return vectors.groupBy(shard).agg(F.count("*").alias("rows"), F.sha2(both, 256).alias("hash"))


def _model(vectors: DataFrame, path: str, key: str) -> KMeansModel:
    spark = vectors.sparkSession
    if manifest(spark, f"{path}/manifest") is None:
        lists = max(1, min(MOST_LISTS, vectors.count() // LIST_ROWS))
        some = vectors.orderBy(F.xxhash64(key)).limit(SAMPLE).select(array_to_vector("embedding").alias("features"))
        KMeans(k=lists, seed=42, maxIter=8, initSteps=1).fit(some).write().overwrite().save(f"{path}/centres")
    return KMeansModel.load(f"{path}/centres")


def refresh(vectors: DataFrame, path: str, shard: str = "shard", key: str = "vec_id") -> dict[str, int]:
    """Bring the index under `path` to what `vectors` (shard, key, embedding) hold; says how many shards there are, and how
    many were written and dropped.  Rows without a vector take no part."""
    spark = vectors.sparkSession
    vectors = vectors.select(shard, key, "embedding").where("embedding IS NOT NULL")
    model = _model(vectors, path, key)
    now, before = _hashes(vectors, shard), manifest(spark, f"{path}/manifest")
    if before is not None and before.select("at").distinct().count() >= MOST_GENERATIONS:
        before = before.limit(0)
    to = f"{path}/lists/{uuid.uuid4().hex}"
    same = now.join(before, [shard, "hash"], "left_semi") if before is not None else now.limit(0)
    stale = now.join(same.select(shard), shard, "left_anti").cache()
    written, shards = stale.count(), now.count()
    if written:
        rows = vectors.join(few(stale.select(shard), BROADCAST_ROWS), shard, "left_semi").withColumn("features", array_to_vector("embedding"))
        placed = model.transform(rows).select(shard, key, "embedding", F.col("prediction").alias("list"))
        placed.repartition("list").sortWithinPartitions("list", shard).write.partitionBy("list").parquet(to)
    rows = stale.withColumn("at", F.lit(to))
    if before is not None:
        rows = rows.unionByName(before.join(same, [shard, "hash"], "left_semi").select(rows.columns))
    publish(rows, f"{path}/manifest")
    stale.unpersist()
    gone = before.join(now, shard, "left_anti").count() if before is not None else 0
    return {"shards": shards, "written": written, "dropped": gone}


def rows(spark: SparkSession, path: str, shard: str = "shard", lists: list[int] | None = None) -> DataFrame:
    """The index's live rows (shard, key, embedding, list), of all lists or of some: only their folders are read."""
    named = manifest(spark, f"{path}/manifest")
    out = None
    for at in sorted(r["at"] for r in named.select("at").distinct().collect()):  # generations, few by the rule above
        live = few(named.where(F.col("at") == at).select(shard), BROADCAST_ROWS)
        got = spark.read.parquet(at)
        got = got.where(F.col("list").isin(lists)) if lists is not None else got
        got = got.join(live, shard, "left_semi")
        out = got if out is None else out.unionByName(got)
    return out


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, shard: str = "shard", key: str = "vec_id") -> DataFrame:
    """(q, key, score, rank): the k rows of largest inner product of each question of (q, qv) in the `probes` lists whose
    centres are nearest (all lists by default, which is exact); a question's own row is left out."""
    spark = queries.sparkSession
    centres = [c.tolist() for c in KMeansModel.load(f"{path}/centres").clusterCenters()]
    if probes is None or probes >= len(centres):
        return nearest(rows(spark, path, shard).withColumnRenamed(key, "vec_id"), queries, k).drop("n").withColumnRenamed("vec_id", key)
    of = spark.createDataFrame(list(enumerate(centres)), "list int, centre array<double>")
    near = queries.join(F.broadcast(of), how="cross").withColumn("near", dot(F.col("qv"), F.col("centre")))  # centres are MOST_LISTS at most
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "list"))
    asked = near.withColumn("place", place).where(F.col("place") <= probes).select("q", "qv", "list").cache()
    wanted = sorted(r["list"] for r in asked.select("list").distinct().collect())
    met = rows(spark, path, shard, wanted).join(few(asked, BROADCAST_ROWS), "list").where(F.col(key) != F.col("q"))
    scored = met.select("q", key, F.round(dot(F.col("embedding"), F.col("qv")), 9).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
