"""Retrieval modes: a table of them, rules over tables of settings and requests, and one call that runs a mode.

A setting is a row (key, judge, fuse, texts): is there a judge's key, is the judge `on`, `off` or `manual` (null: on), are lists
fused unless a request says otherwise, do pages have texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The modes in their order; does one ask the judge, does it read pages' texts.
MODES = [
    ("visual", False, False),
    ("hybrid", False, True),
    ("jev-expand", True, False),
    ("jev", True, False),
    ("jev+hybrid", True, True),
    ("jev-page", True, False),
    ("xray", True, True),
]
SETTING = "key boolean, judge string, fuse boolean, texts boolean"
#: Crops asked for a page that is wanted, and at least.
CROPS_A_PAGE, LEAST_CROPS = 6, 24


def _able() -> Column:
    return F.col("key") & (F.coalesce("judge", F.lit("on")) != "off")


def _usual() -> Column:
    """What a request without a mode gets."""
    return F.when(_able() & (F.coalesce("judge", F.lit("on")) != "manual"), "jev-page").when(F.col("fuse"), "hybrid").otherwise("visual")


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(MODES)], "place int, mode string, asks boolean, reads boolean")


def _hindrance(asks: Column, reads: Column) -> Column:
    return F.when(asks & ~F.col("key"), "judge: no key").when(asks & ~_able(), "judge: off").when(reads & ~F.col("texts"), "pages: no texts")


def offered(settings: DataFrame) -> DataFrame:
    """Each row of `settings` with each mode: place, mode, hindrance (null: it can run) and usual."""
    every = settings.join(F.broadcast(modes(settings.sparkSession)), how="cross")  # seven rows
    return every.select(*settings.columns, "place", "mode", _hindrance(F.col("asks"), F.col("reads")).alias("hindrance"), (F.col("mode") == _usual()).alias("usual"))


def resolved(requests: DataFrame, wish: str = "wish") -> DataFrame:
    """Requests, a setting each, with the mode that their wish stands for and what hinders it; a wish of nothing, `auto` or `default`
    is the usual mode, and one that no mode is called hinders itself."""
    said = F.lower(F.trim(F.coalesce(F.col(wish), F.lit(""))))
    named = requests.withColumn("mode", F.when(said.isin("", "auto", "default"), _usual()).otherwise(said))
    met = named.join(F.broadcast(modes(requests.sparkSession).drop("place")), "mode", "left")
    why = F.when(F.col("asks").isNull(), F.concat(F.lit("unknown: "), "mode")).otherwise(_hindrance(F.col("asks"), F.col("reads")))
    return met.select(*requests.columns, "mode", why.alias("hindrance"))


def crops_wanted(pages: int, stated: int = 0) -> int:
    """A page is found by several of its crops, so more of them are asked for."""
    return stated or max(LEAST_CROPS, CROPS_A_PAGE * pages)


class Hindered(ValueError):
    """The mode that was wished for can't run, and why."""


def run(spark: SparkSession, wish: str | None, setting: tuple, retrievers: dict[str, Callable[[int, int], DataFrame]], pages: int = 4) -> DataFrame:
    """(mode, q, page, rank): what the wish's mode finds.  Retrievers, by mode, take the numbers of pages and crops and give
    ranked pages (q, page, rank)."""
    got = resolved(spark.createDataFrame([(wish, *setting)], f"wish string, {SETTING}")).first()
    if got.hindrance:
        raise Hindered(f"{wish}: {got.hindrance}")
    found = retrievers[got.mode](pages, crops_wanted(pages))
    return found.where(F.col("rank") <= pages).select(F.lit(got.mode).alias("mode"), "q", "page", "rank")


def run_all(spark: SparkSession, setting: tuple, retrievers: dict[str, Callable[[int, int], DataFrame]], pages: int = 4) -> DataFrame:
    """What `run` gives of every mode that nothing hinders."""
    able = [r.mode for r in offered(spark.createDataFrame([setting], SETTING)).where("hindrance IS NULL").orderBy("place").collect()]
    out = None
    for mode in able:
        got = run(spark, mode, setting, retrievers, pages)
        out = got if out is None else out.unionByName(got)
    return out
