"""A sweep that judges every page of a corpus for every question, in calls of a shard of pages each, of which any may fail.

A judge is a function (question, keys, texts, first) -> answers, run in Arrow batches of calls: `scores` by key (0 to 3), the
evidence `answerable`, `scope` and `premise` (0 to 1), and on a corpus's first shard what is asked of the question alone:
`injection`, and (label, confidence) of `kind` and `granularity`; `tokens` is what the call took.  A call that raises gives an
error row, and its pages no scores; an answer out of its range, or a label that isn't one, is none.  So what a sweep
lacks is seen: it is exhaustive only if all pages with a text came back with a score and no call failed."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import few, stored
from . import shards

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a page that are judged, tokens of a call, the tokens that a page's question takes, and shards of a corpus.
CLIP, BUDGET, QUESTION, MAX_SHARDS = 6000, 48_000, 48, 8
#: 1.7 characters are a token; costs are in seventeenths of one, so that they are whole.
UNIT = 17
# Labels that are known, and how many pages each breadth of a question wants.
KINDS = ["price", "spec", "procedure", "catalogue", "other"]
PAGES_FOR = {"value": 2, "passage": 3, "survey": 6}
#: Questions of a block, which tasks are told, and corpora that are broadcast at most.
BLOCK, BROADCAST_ROWS = 4096, 20_000

ANSWERS = """corpus string, q long, shard long, error string, tokens long, scores array<struct<key:bigint,raw:double>>, answerable double, scope double,
premise double, injection double, kind string, kind_confidence double, granularity string, granularity_confidence double"""


@dataclass(frozen=True)
class Sweep:
    """answers: a row a call; scores (corpus, q, key, score), 0 to 1; report: a row for each corpus and question."""

    answers: DataFrame
    scores: DataFrame
    report: DataFrame


class WordJudge:
    """A judge without a model: shares of the question's words, parted by blanks, that pages have."""

    _last: tuple = (None, [])

    def __call__(self, question: str, keys: list[int], texts: list[str], first: bool) -> dict:
        if self._last[0] is not texts:  # one shard is asked many questions
            self._last = texts, [set(t.lower().split(" ")) for t in texts]
        asked = set(question.lower().split(" "))
        had = [asked & words for words in self._last[1]]
        share = [len(h) / len(asked) for h in had]
        out = {"scores": {k: 3 * s for k, s in zip(keys, share)}, "answerable": max(share), "scope": len(set().union(*had)) / len(asked), "premise": sum(not h for h in had) / len(had)}
        return out | {"tokens": (len(question) + sum(map(len, texts))) // 4}


def _number(answers: dict, name: str) -> float | None:
    v = answers.get(name)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1 else None


def _label(answers: dict, name: str, known) -> tuple[str | None, float | None]:
    got = answers.get(name)
    if not isinstance(got, tuple) or got[0] not in known:
        return None, None
    return got[0], _number({"x": got[1]}, "x")


def _row(judge, corpus, shard, keys, texts, q, query) -> dict:
    row, first = {"corpus": corpus, "q": q, "shard": shard}, shard == 0
    try:
        got = judge(query, keys, texts, first)
        scores = got.get("scores", {})
    except Exception as e:  # any failure of a call is a row, not the sweep's end
        return row | {"error": f"{type(e).__name__}: {e}", "tokens": 0, "scores": []}
    ok = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 3
    row |= {"tokens": int(got.get("tokens") or 0), "scores": [{"key": k, "raw": float(scores[k])} for k in keys if ok(scores.get(k))]}
    row |= {name: _number(got, name) for name in ("answerable", "scope", "premise")}
    if first:
        row["injection"] = _number(got, "injection")
        row["kind"], row["kind_confidence"] = _label(got, "kind", KINDS)
        row["granularity"], row["granularity_confidence"] = _label(got, "granularity", PAGES_FOR)
    return row


def calls(pages: DataFrame, max_shards: int = MAX_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(calls, corpora) of pages (corpus, key, text): calls (corpus, shard, pages) of corpora that aren't refused, and (corpus, pages,
    blind, shards, refused) of all; a corpus of over `max_shards` shards is."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, CLIP)
    given = pages.select("corpus", "key", text.alias("text")).withColumn("blind", F.trim("text") == "")
    readable = given.where("NOT blind").select("corpus", "key", "text")
    placed = shards.plan(readable.select("corpus", "key", (F.char_length("text") * 10 + UNIT * QUESTION).alias("cost")), "corpus", "key", UNIT * BUDGET)
    n = placed.groupBy("corpus").agg((F.max("shard") + 1).alias("shards"))
    corpora = given.groupBy("corpus").agg(F.count("*").alias("pages"), F.count_if("blind").alias("blind")).join(n, "corpus", "left")
    corpora = corpora.withColumn("refused", F.coalesce(F.col("shards") > max_shards, F.lit(False))).withColumn("shards", F.when(F.col("refused"), 0).otherwise(F.coalesce("shards", F.lit(0))))
    taken = placed.join(few(corpora.where("NOT refused").select("corpus"), BROADCAST_ROWS), "corpus", "left_semi")
    # A shard keeps to its budget, so its pages are a bounded array.
    met = readable.join(taken, ["corpus", "key"]).groupBy("corpus", "shard").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("pages"))
    return met, corpora


def _caller(judge, asked: list, kinds):
    def work(batches):
        import pyarrow as pa

        for b in batches:
            for corpus, shard, keys, texts in zip(*(c.to_pylist() for c in b.columns)):
                for at in range(0, len(asked), 256):
                    some = [_row(judge, corpus, shard, keys, texts, r.q, r.query) for r in asked[at : at + 256]]
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kinds.names} for r in some], schema=kinds)

    return work


def sweep(questions: DataFrame, pages: DataFrame, judge: Callable | None = None, max_shards: int = MAX_SHARDS, seen: Observation | None = None) -> Sweep:
    """Judge `pages` (corpus, key, text) for `questions` (q, query).  `seen` gets calls, failed and tokens."""
    judge = judge or WordJudge()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(ANSWERS))
    made, corpora = calls(pages, max_shards)
    # Each shard of each corpus is asked each question, for that is the sweep.  A shard goes to a task once a block of questions.
    n = questions.count()
    block = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n // BLOCK))))
    parts = [questions.where(block == i).select("q", "query").collect() for i in range(-(-n // BLOCK))] or [[]]
    asked = [made.select("corpus", "shard", F.col("pages.key").alias("keys"), F.col("pages.text").alias("texts")).mapInArrow(_caller(judge, p, kinds), ANSWERS) for p in parts]
    answers = reduce(DataFrame.unionByName, asked)
    if seen:
        answers = answers.observe(seen, F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("tokens").alias("tokens"))
    answers = stored(answers, "sweep-answers")  # a call is paid once, whoever reads its answers
    scores = answers.select("corpus", "q", F.explode("scores").alias("s")).select("corpus", "q", "s.key", (F.col("s.raw") / 3).alias("score"))
    per = answers.groupBy("corpus", "q").agg(
        F.sum(F.size("scores")).alias("judged"), F.count("error").alias("failed_shards"), F.sum("tokens").alias("tokens"),
        (F.max(F.array_max(F.transform("scores", lambda s: s["raw"]))) / 3).alias("best"),
        *(F.round(F.max(c), 4).alias(c) for c in ("answerable", "scope", "premise", "injection", "kind_confidence", "granularity_confidence")),
        *(F.max(c).alias(c) for c in ("kind", "granularity")),
    )
    every = corpora.join(few(questions.select("q"), BROADCAST_ROWS), how="cross").join(per, ["corpus", "q"], "left").na.fill(0, ["judged", "failed_shards", "tokens"])
    lacks: Column = F.col("pages") - F.col("blind") - F.col("judged")
    wanted = F.create_map(*(F.lit(x) for kv in PAGES_FOR.items() for x in kv))
    report = every.select(
        "corpus", "q", "pages", "blind", "judged", (F.col("pages") - F.col("judged")).alias("unjudged"), "shards", "failed_shards", "refused",
        ((lacks == 0) & (F.col("failed_shards") == 0)).alias("exhaustive"), F.round("best", 4).alias("best"), "tokens",
        "answerable", "scope", "premise", "injection", "kind", "kind_confidence", "granularity", "granularity_confidence", F.try_element_at(wanted, F.col("granularity")).alias("pages_wanted"),
    )
    return Sweep(answers, scores, report)


def labels(made: Sweep, least: float) -> DataFrame:
    """(corpus, q, outcome, gold, best) of each question: a sweep that isn't exhaustive labels nothing, for a page that it did not judge
    might be the best one; gold is the first of the best pages, if their score is `least` or more."""
    top = F.max(F.struct("score", (-F.col("key")).alias("key"))).alias("t")
    best = made.scores.groupBy("corpus", "q").agg(top).select("corpus", "q", F.col("t.score").alias("score"), (-F.col("t.key")).alias("key"))
    rows = made.report.select("corpus", "q", "judged", "exhaustive").join(best, ["corpus", "q"], "left")
    outcome = F.when(F.col("judged") == 0, "failed").when(~F.col("exhaustive"), "partial").when(F.col("score") >= least, "gold").otherwise("none")
    rows = rows.withColumn("outcome", outcome)
    sure = F.col("outcome").isin("gold", "none")
    return rows.select("corpus", "q", "outcome", F.when(F.col("outcome") == "gold", F.col("key")).alias("gold"), F.when(sure, F.round("score", 4)).alias("best"))
