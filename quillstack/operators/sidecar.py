"""The text sidecar of an index (a row for each page), its report, and merging new rows into old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import revision

#: Pages of fewer characters have no text to search or judge.
BLIND_CHARS = 20


def build(pages: DataFrame, title: str, page: str, text: str) -> DataFrame:
    """(title, page, text, visual_only, revision) of every page."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    return pages.select(F.col(title).alias("title"), F.col(page).alias("page"), F.col(text).alias("text"), (F.char_length(bare) < BLIND_CHARS).alias("visual_only"), revision(F.col(text)).alias("revision"))


def report(sidecar: DataFrame) -> DataFrame:
    """(title, pages, visual_only, revisions, newest): of several revisions answers should prefer the newest."""
    return sidecar.groupBy("title").agg(F.count("*").alias("pages"), F.count_if("visual_only").alias("visual_only"), F.count_distinct("revision").alias("revisions"), F.max("revision").alias("newest"))


def with_chunks(reported: DataFrame, manifests: DataFrame) -> DataFrame:
    """A report with the chunks that the manifests (title, num_chunks, blank_skipped) name, and those left out as blank."""
    sums = manifests.groupBy("title").agg(F.sum(F.coalesce("num_chunks", F.lit(0))).alias("chunks"), F.sum(F.coalesce("blank_skipped", F.lit(0))).alias("blanks"))
    return reported.join(sums, "title", "left").na.fill(0, ["chunks", "blanks"])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those of their key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = F.struct(*(c for c in old.columns if c != key))
    return both.groupBy(key).agg(F.max_by(rest, "__new").alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in old.columns if c != key)).select(*old.columns)
