"""Sweeps of corpora by a judge that may fail, and labels that they give.  A corpus is a source's documents, 2,000 ids at a time."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..operators import sweep as W
from .registry import query
from .retrieval import read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What is asked of a question alone is told by its length here; the last kind is no known label.
_KINDS, _BREADTHS = [*W.KINDS, "riddle"], list(W.PAGES_FOR)
RELEVANT = 0.66


class Flaky(W.WordJudge):
    """Fails where the pages' ids and the question's length agree modulo 5."""

    def __call__(self, question, keys, texts, first):
        n = len(question)
        if sum(keys) % 5 == n % 5:
            raise TimeoutError("no answer")
        out = super().__call__(question, keys, texts, first)
        if first:
            out |= {"injection": n % 7 / 10, "kind": (_KINDS[n % 6], 0.5 + n % 5 / 10), "granularity": (_BREADTHS[n % 3], 0.9)}
        return out


SWEPT = f"""corp AS (SELECT doc_id, source || '/' || CAST(doc_id // 2000 AS VARCHAR) AS corpus, substr(coalesce(text, ''), 1, {W.CLIP}) AS text FROM documents), rd AS (SELECT * FROM corp WHERE trim(text) <> ''),
o AS (SELECT corpus, doc_id, length(text) * 10 + {W.UNIT * W.QUESTION} AS cost, row_number() OVER (PARTITION BY corpus ORDER BY doc_id) AS i FROM rd),
f AS (SELECT corpus, doc_id, i, CAST(0 AS BIGINT) AS shard, cost AS size FROM o WHERE i = 1 UNION ALL
SELECT o.corpus, o.doc_id, o.i, CASE WHEN f.size + o.cost > {W.UNIT * W.BUDGET} THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.size + o.cost > {W.UNIT * W.BUDGET} THEN o.cost ELSE f.size + o.cost END FROM f JOIN o ON o.corpus = f.corpus AND o.i = f.i + 1),
ns AS (SELECT corpus, max(shard) + 1 AS n FROM f GROUP BY corpus), cc AS (SELECT corpus, count(*) AS pages, count(*) FILTER (trim(text) = '') AS blind FROM corp GROUP BY corpus),
co AS (SELECT cc.*, coalesce(n > {W.MAX_SHARDS}, false) AS refused, CASE WHEN n > {W.MAX_SHARDS} THEN 0 ELSE coalesce(n, 0) END AS shards FROM cc LEFT JOIN ns USING (corpus)),
iw AS (SELECT item_id AS q, length(text) AS ql, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark),
pw AS (SELECT f.corpus, f.shard, f.doc_id, rd.text, list_distinct(string_split(lower(rd.text), ' ')) AS w FROM f JOIN rd USING (corpus, doc_id) JOIN co USING (corpus) WHERE NOT refused),
sc AS (SELECT corpus, shard, doc_id, q, ql, length(text) AS chars, len(list_intersect(pw.w, iw.w)) AS n, len(iw.w) AS m FROM pw CROSS JOIN iw),
wd AS (SELECT DISTINCT corpus, shard, word FROM (SELECT corpus, shard, unnest(w) AS word FROM pw)), sp AS (SELECT corpus, shard, q, count(*) AS had FROM wd JOIN (SELECT q, unnest(w) AS word FROM iw) USING (word) GROUP BY ALL),
ca AS (SELECT corpus, shard, q, ql, sum(doc_id) % 5 = ql % 5 AS failed, count(*) AS judged, max(n * 1e0 / m) AS best, avg(CASE WHEN n = 0 THEN 1e0 ELSE 0e0 END) AS premise, (ql + sum(chars)) // 4 AS tokens, max(m) AS m FROM sc GROUP BY corpus, shard, q, ql),
cs AS (SELECT ca.*, coalesce(had, 0) * 1e0 / m AS scope FROM ca LEFT JOIN sp USING (corpus, shard, q)),
per AS (SELECT corpus, q, sum(judged) FILTER (NOT failed) AS judged, count(*) FILTER (failed) AS failed_shards, sum(tokens) FILTER (NOT failed) AS tokens, round(max(best) FILTER (NOT failed), 4) AS best, round(max(premise) FILTER (NOT failed), 4) AS premise, round(max(scope) FILTER (NOT failed), 4) AS scope,
bool_or(shard = 0 AND NOT failed) AS first FROM cs GROUP BY corpus, q),
rep AS (SELECT co.corpus, iw.q, ql, pages, blind, shards, refused, coalesce(judged, 0) AS judged, coalesce(failed_shards, 0) AS failed_shards, coalesce(tokens, 0) AS tokens, best, premise, scope, coalesce(first, false) AS first FROM co CROSS JOIN iw LEFT JOIN per ON per.corpus = co.corpus AND per.q = iw.q)"""
_PICK = lambda names, by: "CASE " + " ".join(f"WHEN ql % {by} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def flaky_sweep(spark, sf_dir) -> W.Sweep:
    docs = read(spark, sf_dir, "documents")
    corpus = F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 2000).cast("string"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("query"))
    return W.sweep(items, docs.select(corpus.alias("corpus"), F.col("doc_id").alias("key"), "text"), Flaky())


@query("xray_sweep", f"""WITH RECURSIVE {SWEPT} SELECT corpus, q AS item_id, pages, CAST(blind AS BIGINT) AS blind, CAST(judged AS BIGINT) AS judged, CAST(pages - judged AS BIGINT) AS unjudged, shards, failed_shards, refused, judged = pages - blind AND failed_shards = 0 AS exhaustive, best, CAST(tokens AS BIGINT) AS tokens,
best AS answerable, scope, premise, CASE WHEN first THEN round(ql % 7 / 1e1, 4) END AS injection, CASE WHEN first THEN {_PICK(W.KINDS, 6)} END AS kind, CASE WHEN first AND ql % 6 < 5 THEN round(0.5e0 + ql % 5 / 1e1, 4) END AS kind_confidence,
CASE WHEN first THEN {_PICK(_BREADTHS, 3)} END AS granularity, CASE WHEN first THEN 0.9e0 END AS granularity_confidence, CASE WHEN first THEN CASE ql % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 6 END END AS pages_wanted FROM rep""")
def xray_sweep(spark, sf_dir):
    """The report of a sweep in which calls fail: what came back says whether it was exhaustive."""
    return flaky_sweep(spark, sf_dir).report.withColumnRenamed("q", "item_id")


@query("oracle_sweep", f"""WITH RECURSIVE {SWEPT}, ok AS (SELECT sc.corpus, sc.q, doc_id, n * 1e0 / sc.m AS s FROM sc JOIN ca ON ca.corpus = sc.corpus AND ca.shard = sc.shard AND ca.q = sc.q WHERE NOT failed),
b AS (SELECT corpus, q, max(s) AS s, arg_max(doc_id, (s, -doc_id)) AS gold FROM ok GROUP BY ALL),
r AS (SELECT rep.corpus, rep.q, CASE WHEN judged = 0 THEN 'failed' WHEN NOT (judged = pages - blind AND failed_shards = 0) THEN 'partial' WHEN s >= {RELEVANT}e0 THEN 'gold' ELSE 'none' END AS outcome, gold, s FROM rep LEFT JOIN b ON b.corpus = rep.corpus AND b.q = rep.q)
SELECT corpus, q AS item_id, outcome, CASE WHEN outcome = 'gold' THEN gold END AS gold, CASE WHEN outcome IN ('gold', 'none') THEN round(s, 4) END AS best FROM r""")
def oracle_sweep(spark, sf_dir):
    """Gold pages from the sweep: a partial one labels nothing."""
    return W.labels(flaky_sweep(spark, sf_dir), RELEVANT).withColumnRenamed("q", "item_id")
