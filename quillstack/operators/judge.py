"""Judges: what scores texts for queries, and what is done with scores.

A judge is any object with `score(pairs)`, which adds a nullable raw column (0..3) to a DataFrame
of (query, text); `OverlapJudge` is the deterministic default, built of columns.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_variants, tokenise
from ..sources.shared import few
from .contain import overlaps


#: Characters of a page that are judged; least score of a facet that is added, and how many are at most.
CLIP, FACET_THRESHOLD, MAX_FACETS = 6000, 0.7, 2


#: Words of a crop (1,024 pixels of lines of 40, eight words a line), and from one crop's first to the next one's (640 pixels).
STRIP, STEP = 205, 128


class Judge(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame: ...

    def sweep(self, questions: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame: ...


class OverlapJudge:
    """Three times the share of the query's distinct tokens that the text has; null for no text."""

    def sweep(self, questions: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
        """(q, key, raw) of every page of (key, text) for every question of (q, query), those of 0 left out:
        each page is tokenised once, and its tokens looked up among the questions'.  With `most`, pages that may be among a question's
        so many best, the first keys' of equals."""
        asked = questions.select(F.col("q").alias("item"), F.array_distinct(tokenise(F.col("query"))).alias("words"))
        pages = pages.select("key", F.array_distinct(tokenise(F.substring("text", 1, CLIP))).alias("words"))
        return overlaps(pages, asked, 0.0, most).select(F.col("item").alias("q"), "key", (3 * F.col("n") / F.greatest("of", F.lit(1))).alias("raw"))

    def score(self, pairs: DataFrame) -> DataFrame:
        q, t = F.array_distinct(tokenise(F.col("query"))), tokenise(F.substring("text", 1, CLIP))
        share = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
        return pairs.withColumn("raw", F.when(F.length(F.trim("text")) > 0, 3 * share))


def valid(raw):
    return ~F.isnan(raw) & raw.between(0, 3)


def expand(questions: DataFrame, facets: list[str], judge: Judge | None = None) -> DataFrame:
    """(q, ord, variant) of (q, query): the question, its noun phrase, and the last of these with each of the
    best facets that the judge finds asked for.  One invalid score, or none, leaves the local variants."""
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("facet")) for i, f in enumerate(facets))))
    pairs = questions.select("q", F.col("query").alias("question"), named.alias("f")).select("q", "question", "f.i", F.col("f.facet").alias("query"), F.col("question").alias("text"))
    scored = (judge or OverlapJudge()).score(pairs)
    best = F.array_sort(F.collect_list(F.struct((-F.col("raw") / 3).alias("down"), "i", F.col("query").alias("facet"))))
    good = F.min(F.coalesce(valid(F.col("raw")), F.lit(False)).cast("int")) == 1
    by = scored.groupBy("q", "question").agg(best.alias("best"), good.alias("good"))
    own = query_variants(F.col("question"))
    top = F.filter(F.slice("best", 1, MAX_FACETS), lambda x: -x["down"] >= FACET_THRESHOLD)
    more = F.when(F.col("good"), F.transform(top, lambda x: F.concat_ws(" ", F.element_at("own", -1), x["facet"]))).otherwise(F.array().cast("array<string>"))
    rows = by.withColumn("own", own).select("q", F.array_distinct(F.concat("own", more)).alias("v"))
    return rows.select("q", F.posexplode("v").alias("ord", "variant"))


def order_pages(scored: DataFrame, by: str = "q", place: str = "prior") -> DataFrame:
    """Adds score and rank: judged pages best first, those without a score behind them in the search's order."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("raw"), place)
    return scored.withColumn("score", F.col("raw") / 3).withColumn("rank", F.row_number().over(order))


def gate(scored: DataFrame, scope: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(q, answerable, scope, verdict): the best of a question's pages (q, raw), its `scope` (q, scope), both 0..1."""
    best = scored.groupBy("q").agg(F.round(F.max("raw") / 3, 4).alias("answerable"))
    rows = scope.join(best, "q", "left").select("q", "answerable", F.round("scope", 4).alias("scope"))
    return rows.withColumn("verdict", verdict(F.col("scope"), F.col("answerable"), threshold))


def corpus_scope(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(q, scope): share of a question's distinct tokens that any page has."""
    asked = questions.select(F.explode(F.array_distinct(tokenise(F.col("query")))).alias("term"))
    vocab = few(asked.select("term").distinct(), 100_000)
    known = pages.select(F.explode(F.array_distinct(tokenise(F.col("text")))).alias("term")).join(vocab, "term", "left_semi").distinct()
    return known_scope(questions, known)


def known_scope(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(q, scope): share of a question's distinct tokens that are among `known` (term, each once)."""
    asked = questions.select("q", F.explode_outer(F.array_distinct(tokenise(F.col("query")))).alias("term"))
    return asked.join(known.withColumn("known", F.lit(1.0)), "term", "left").groupBy("q").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("scope"))


def fold_shards(scored: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """(q, answerable, shards): each shard's best page of (q, key, raw), and of these the best: a shard that
    has nothing can't outvote one that does.  `shards` has (key, shard); without, keys are shards', whose pages were swept under them."""
    of = scored.join(shards, "key") if shards is not None else scored.withColumnRenamed("key", "shard")
    each = of.groupBy("q", "shard").agg((F.max("raw") / 3).alias("best"))
    return each.groupBy("q").agg(F.round(F.max("best"), 4).alias("answerable"), F.count("*").alias("shards"))


def crop_texts(pages: DataFrame, text: str = "text", crop: str = "crop", strip: int = STRIP, step: int = STEP) -> DataFrame:
    """`pages` with a row for each crop: words of a page stand in lines, and a crop is a strip of `strip` words, `step` behind the
    one before it; the last reaches the end.  `text` is the crop's, up to what is judged of one."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), " ", -1)
    last = F.greatest(F.lit(0), F.ceil((F.size("__words") - strip) / step)).cast("int")
    rows = pages.withColumn("__words", words).withColumn(crop, F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn(text, F.substring(F.array_join(F.slice("__words", F.col(crop) * step + 1, strip), " "), 1, CLIP)).drop("__words")


def best_crops(scored: DataFrame, by: list[str], crop: str = "crop") -> DataFrame:
    """The crop of each page that the judge scores highest, the first of equals; an invalid score is kept, for `rerank` to see."""
    bad = F.col("raw").isNotNull() & ~F.coalesce(valid(F.col("raw")), F.lit(False))
    order = Window.partitionBy(*by).orderBy(bad.desc(), F.desc_nulls_last(F.round("raw", 9)), crop)
    return scored.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def rerank(scored: DataFrame, limit: int, by: str = "q", place: str = "ord") -> DataFrame:
    """Candidates with raw scores in the judge's order; one invalid score of a query puts the
    search's order back for all of it.  Candidates without a text go."""
    bad = F.col("raw").isNotNull() & (F.isnan("raw") | ~F.col("raw").between(0, 3))
    fell = F.max(bad.cast("int")).over(Window.partitionBy(by)) == 1
    rows = scored.withColumn("fell", fell).where("fell or raw is not null")
    order = Window.partitionBy(by).orderBy(F.when(F.col("fell"), 0.0).otherwise(-F.col("raw")), place)
    return rows.withColumn("score", F.when(~F.col("fell"), F.col("raw") / 3)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def verdict(scope, answerable, threshold: float = 0.3):
    """out-of-scope before not-in-corpus; nulls pass."""
    return F.when(scope < 0.5, "out-of-scope").when(answerable < threshold, "not-in-corpus").otherwise("ok")


class Mirrored:
    """A judge that is shown its rubric backwards, so its best is 0, and so much of each text."""

    def __init__(self, judge: Judge, chars: int = CLIP):
        self.judge, self.chars = judge, chars

    def score(self, pairs: DataFrame) -> DataFrame:
        return self.judge.score(pairs.withColumn("text", F.substring("text", 1, self.chars))).withColumn("raw", 3 - F.col("raw"))


def order_drift(pairs: DataFrame, forward: Judge, backward: Judge) -> DataFrame:
    """(q, n, mean_drift, max_drift, top1_stable, top3_stable) of pairs (q, query, key, ord, text), a bounded number a question, that
    are judged twice: how far scores move when the rubric is turned round, and whether the best stay the best.
    Pairs that a run gives no valid score are left out."""
    a = forward.score(pairs).select("q", "key", "ord", F.col("raw").alias("fwd"))
    b = backward.score(pairs).select("q", "key", (3 - F.col("raw")).alias("rev"))
    both = a.join(b, ["q", "key"]).where(valid(F.col("fwd")) & valid(F.col("rev")))
    place = lambda c: F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round(c, 9)), "ord"))
    both = both.withColumn("f", place("fwd")).withColumn("r", place("rev")).withColumn("moved", F.abs(F.col("fwd") - F.col("rev")))
    top = F.least(F.count("*"), F.lit(3)) == F.count_if((F.col("f") <= 3) & (F.col("r") <= 3))
    return both.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg("moved"), 6).alias("mean_drift"), F.round(F.max("moved"), 6).alias("max_drift"), (F.count_if(F.expr("f = 1 AND r = 1")) == 1).alias("top1_stable"), top.alias("top3_stable"))
