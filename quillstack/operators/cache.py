"""The answer cache as a table: (namespace, entry, embedding, created, last_used, ...).

A question is matched by its vector, a namespace exactly: all that changes the answer to one question is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import dot, nearest

THRESHOLD, MOST = 0.95, 2000


def namespace_key(provider: str, model: str, mode: str, retrieval: str, pages: int, judge: str, index: str | Column) -> Column:
    """What has to be equal for an answer to be the same question's: model, modes, page budget, judge, index."""
    parts = [provider, model, mode, f"ret:{retrieval}", f"k{pages}", judge]
    return F.concat_ws("|", *(F.lit(x) for x in parts), index if isinstance(index, Column) else F.lit(index))


def unit(v: Column) -> Column:
    """A vector over its length; null for one without length."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def lookup(entries: DataFrame, probes: DataFrame, threshold: float = THRESHOLD, max_probes: int = 4096) -> DataFrame:
    """(probe, entry, similarity, served) of (probe, namespace, embedding): the nearest entry of the probe's
    namespace, the earlier of two as near; a probe without one in its namespace has no row.

    Probes are broadcast up to `max_probes`, or else met by namespace and a part of its entries.  Entries that are no
    nearer than the nearest of a sample are dropped where they are made (`nearest`)."""
    asked = probes.select(F.col("probe").alias("q"), "namespace", F.col("embedding").alias("qv")).where(F.col("qv").isNotNull())
    found = nearest(entries.select(F.col("entry").alias("vec_id"), "namespace", "embedding"), asked, 1, by="namespace", max_queries=max_probes)
    return found.select(F.col("q").alias("probe"), F.col("vec_id").alias("entry"), F.col("score").alias("similarity"), (F.col("score") >= threshold).alias("served"))


def kept(entries: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` entries that were used or made last; of equals the earlier ones."""
    return entries.orderBy(F.desc(F.coalesce("last_used", "created")), "entry").limit(most)


def put(entries: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """`entries` and `new`, of which the ones not used for longest go.  Vectors without length are no key; if the
    new vectors have another length than the old ones, another model made them, and the cache begins anew."""
    new = new.where(unit(F.col("embedding")).isNotNull())
    width = new.select(F.size("embedding").alias("w")).limit(1)
    old = entries.join(F.broadcast(width.withColumnRenamed("w", "__w")), how="cross").where(F.size("embedding") == F.col("__w")).drop("__w") if width.count() else entries
    return kept(old.unionByName(new), most)
