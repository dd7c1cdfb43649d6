"""Evaluation statistics.

Outcomes come from three search modes over the vectors: the first 16, 32 or all dimensions.  A
query's gold pages are those of its three nearest vectors, its primary page that of the nearest.
Judged signals are documents' lengths against their quality labels, latencies those of events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordinal import nearest_rank, with_group_ordinal, with_running
from ..operators.vector import nearest
from .registry import query, shared
from .retrieval import read

#: The three modes' hits at the greatest depth that is read, made once and kept.
RK = """dims AS (SELECT 16 AS n UNION ALL SELECT 32 AS n UNION ALL SELECT 64 AS n),
qs AS (SELECT <div(vec_id;50)> AS q, vec_id AS own, embedding AS e, label % 3 AS kind FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT n, q, kind, b.vec_id, round(<dot(<slice(b.embedding;n)>;<slice(qs.e;n)>)>, 9) AS s FROM embeddings b JOIN qs ON b.vec_id <> qs.own CROSS JOIN dims),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, q ORDER BY s DESC, vec_id) AS r FROM sc) x WHERE r <= 24)"""


def mode_hits(spark, sf_dir):
    """(n, q, kind, vec_id, s, r): what `RK` says, by one pass over the dimensions."""
    e = read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    best = nearest(e, asked, 24, [16, 32, 64]).withColumns({"q": F.floor(F.col("q") / 50), "s": F.col("score"), "r": F.col("rank")})
    kinds = e.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("q"), (F.col("label") % 3).alias("kind"))
    return best.join(kinds, "q").select("n", "q", "kind", "vec_id", "s", "r")


OUT = RK + """,
pg AS (SELECT n, q, kind, <div(vec_id;8)> AS page, min(r) AS r FROM rk WHERE r <= 12 GROUP BY n, q, kind, <div(vec_id;8)>),
pr AS (SELECT *, row_number() OVER (PARTITION BY n, q ORDER BY r) AS rank FROM pg),
gold AS (SELECT q, <div(vec_id;8)> AS page, min(r) AS g FROM rk WHERE n = 64 AND r <= 3 GROUP BY q, <div(vec_id;8)>),
ng AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q),
res AS (SELECT n AS mode, pr.q, kind, n_gold, max(CASE WHEN rank = 1 AND g = 1 THEN 1 ELSE 0 END) AS top1, max(CASE WHEN rank = 1 AND g IS NOT NULL THEN 1 ELSE 0 END) AS any1,
        count(g) AS n_hit FROM pr JOIN ng ON pr.q = ng.q LEFT JOIN gold ON pr.q = gold.q AND pr.page = gold.page WHERE rank <= 4 GROUP BY n, pr.q, kind, n_gold)"""

shared("recall_at_k", f"WITH {OUT} SELECT mode, q AS query_id, n_hit, n_gold FROM res", keep=(RK, "rk", mode_hits))
shared("bench_metrics", f"""WITH {OUT} SELECT mode, count(*) AS n, <long(sum(top1))> AS top1, <long(sum(CASE WHEN n_hit > 0 THEN 1 ELSE 0 END))> AS recalled,
<long(sum(n_hit))> AS gold_hit, <long(sum(n_gold))> AS gold, <long(sum(least(n_gold, 4)))> AS ceiling, median(CAST(n_hit AS DOUBLE)) AS median_hits FROM res GROUP BY mode""", keep=(RK, "rk", mode_hits))
shared("eval_by_kind", f"""WITH {OUT} SELECT mode, kind, count(*) AS n, <long(sum(any1))> AS top1_any, round(avg(n_hit * 1e0 / n_gold), 9) AS coverage
FROM res GROUP BY GROUPING SETS ((mode, kind), (mode))""", keep=(RK, "rk", mode_hits))
shared("wilson_ci", f"""WITH {OUT}, k AS (SELECT mode, CAST(sum(top1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM res GROUP BY mode),
w AS (SELECT mode, (k / n + 1.9208e0 / n) / (1 + 3.8416e0 / n) AS mid, 1.96e0 * sqrt(k / n * (1 - k / n) / n + 0.9604e0 / (n * n)) / (1 + 3.8416e0 / n) AS half FROM k)
SELECT mode, round(greatest(mid - half, 0e0), 9) AS lo, round(least(mid + half, 1e0), 9) AS hi FROM w""", keep=(RK, "rk", mode_hits))
shared("mcnemar_pairs", f"""WITH {OUT}, pair AS (SELECT a.mode AS a, b.mode AS b, <long(sum(CASE WHEN a.top1 > b.top1 THEN 1 ELSE 0 END))> AS only_a, <long(sum(CASE WHEN a.top1 < b.top1 THEN 1 ELSE 0 END))> AS only_b
FROM res a JOIN res b ON a.q = b.q AND a.mode < b.mode GROUP BY a.mode, b.mode),
i AS (SELECT a, b, only_a + only_b AS n, <unnest(<series(0;least(only_a, only_b))>)> AS i FROM pair),
f AS (SELECT a, b, n, sum(CASE WHEN i = 0 THEN 0e0 ELSE ln((n - i + 1) * 1e0 / i) END) OVER (PARTITION BY a, b ORDER BY i) - n * ln(2e0) AS lg FROM i),
s AS (SELECT a, b, least(1e0, 2 * sum(exp(lg))) AS p FROM f GROUP BY a, b)
SELECT pair.a AS mode_a, pair.b AS mode_b, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1e0 ELSE p END, 9) AS p FROM pair JOIN s ON pair.a = s.a AND pair.b = s.b""", keep=(RK, "rk", mode_hits))

SIG = "sig AS (SELECT l.doc_id, least(n_chars, 4000) / 4e3 AS signal, quality, toxic, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
shared("reliability_bins", f"""WITH {SIG} SELECT least(<int(floor(signal * 5))>, 4) AS bin, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 9) AS actual
FROM sig WHERE signal IS NOT NULL GROUP BY least(<int(floor(signal * 5))>, 4)""")
#: AUC by average ranks: no pairs are made.
_AUC = f"""WITH {SIG}, v AS (SELECT signal, <long(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END))> AS p, <long(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END))> AS n FROM sig WHERE signal IS NOT NULL AND quality IS NOT NULL GROUP BY signal),
c AS (SELECT p, n, sum(n) OVER (ORDER BY signal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM v),
m AS (SELECT quality, median(signal) AS m FROM sig GROUP BY quality)
SELECT round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n * 5e-1)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) END, 9) AS auc,
(SELECT max(m) FROM m WHERE quality = 1) AS median_positive, (SELECT max(m) FROM m WHERE quality = 0) AS median_negative FROM c"""


@query("auc", _AUC)
def auc(spark, sf_dir):
    """Running sums over ranges of signals: no task holds all of them."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    sig = docs.join(labels, "doc_id").select((F.least("n_chars", F.lit(4000)) / 4e3).alias("signal"), "quality")
    of = lambda v: F.sum((F.col("quality") == v).cast("long"))
    each = sig.where("signal IS NOT NULL AND quality IS NOT NULL").groupBy("signal").agg(of(1).alias("p"), of(0).alias("n"))
    run = with_running(each, [], ["signal"], {"upto": F.col("n")})
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    area = run.agg(F.round(F.when(pairs > 0, F.sum(F.col("p") * (F.col("upto") - F.col("n") + F.col("n") * 0.5)) / pairs), 9).alias("auc"))
    middle = lambda v: F.median(F.when(F.col("quality") == v, F.col("signal")))
    return area.join(F.broadcast(sig.agg(middle(1).alias("median_positive"), middle(0).alias("median_negative"))))


shared("operating_points", f"""WITH {SIG}, t AS (SELECT 0.1e0 AS t UNION ALL SELECT 0.3e0 AS t UNION ALL SELECT 0.5e0 AS t UNION ALL SELECT 0.7e0 AS t UNION ALL SELECT 0.9e0 AS t)
SELECT t AS threshold, <long(sum(CASE WHEN signal >= t THEN 1 ELSE 0 END))> AS answered, <long(sum(CASE WHEN signal >= t AND quality = 1 THEN 1 ELSE 0 END))> AS correct,
<long(sum(CASE WHEN signal < t AND quality = 1 THEN 1 ELSE 0 END))> AS wrongly_refused, count(*) AS n FROM sig CROSS JOIN t GROUP BY t""")
# Nearest rank round(p/100 * n) - 1, halves to even.
_PERCENTILES = """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT 50 AS p UNION ALL SELECT 95 AS p UNION ALL SELECT 99 AS p),
k AS (SELECT *, p * n AS x FROM v CROSS JOIN p),
r AS (SELECT *, <div(x;100)> + CASE WHEN x % 100 > 50 OR (x % 100 = 50 AND <div(x;100)> % 2 = 1) THEN 1 ELSE 0 END AS near FROM k)
SELECT event_type, p AS percentile, value FROM r WHERE i = least(n - 1, greatest(0, near - 1))"""


@query("latency_percentiles", _PERCENTILES)
def latency_percentiles(spark, sf_dir):
    """Places in each type by ranges of values: no type is sorted in one task."""
    rows = with_group_ordinal(read(spark, sf_dir, "events").where("value is not null").select("event_type", "value", "event_id"), ["event_type"], ["value", "event_id"])
    wanted = F.array(*(F.struct(F.lit(p).alias("percentile"), nearest_rank(p, F.col("ordinal_of")).alias("at")) for p in (50, 95, 99)))
    return rows.withColumn("w", F.explode(F.filter(wanted, lambda w: w["at"] == F.col("ordinal")))).select("event_type", "w.percentile", "value")


shared("paired_ab", """WITH d AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END) AS delta FROM events GROUP BY user_id),
s AS (SELECT count(*) AS n, median(delta) AS median_delta, avg(delta) AS mean_delta, stddev_samp(delta) AS stdev, avg(CASE WHEN delta < 0 THEN 1e0 ELSE 0e0 END) AS win_share FROM d WHERE delta IS NOT NULL)
SELECT n, round(median_delta, 6) AS median_delta, round(mean_delta, 6) AS mean_delta, round(stdev, 6) AS stdev, round(win_share, 9) AS win_share,
CASE WHEN n > 0 THEN CASE WHEN win_share > 0.6e0 THEN 'A' WHEN win_share < 0.4e0 THEN 'B' ELSE 'TIED' END END AS verdict FROM s""")


@query("config_sweep", """WITH run AS (SELECT event_type, user_id % 5 AS run, value, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type, user_id % 5) AS n FROM events),
p95 AS (SELECT event_type, run, value FROM run WHERE i = greatest(1, <div(95 * n + 50;100)>))
SELECT event_type, median(value) AS median_p95, min(value) AS min_p95, max(value) AS max_p95 FROM p95 GROUP BY event_type""")
def config_sweep(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("run"), "value", "event_id")
    rows = with_group_ordinal(e, ["event_type", "run"], ["value", "event_id"])
    at = F.greatest(F.lit(1), F.floor((95 * F.col("ordinal_of") + 50) / 100))
    p95 = rows.where(F.col("ordinal") + 1 == at)
    return p95.groupBy("event_type").agg(F.median("value").alias("median_p95"), F.min("value").alias("min_p95"), F.max("value").alias("max_p95"))


# The grid of agreement and lexical weights; lists are made once, then keyed by the cell.
SWEEP = """a AS (SELECT 0e0 AS a UNION ALL SELECT 0.05e0 UNION ALL SELECT 0.1e0 UNION ALL SELECT 0.15e0 UNION ALL SELECT 0.18e0 UNION ALL SELECT 0.2e0 UNION ALL SELECT 0.25e0 UNION ALL SELECT 0.3e0 UNION ALL SELECT 0.35e0 UNION ALL SELECT 0.5e0),
w AS (SELECT 0e0 AS w UNION ALL SELECT 0.25e0 UNION ALL SELECT 0.5e0 UNION ALL SELECT 0.75e0 UNION ALL SELECT 1e0 UNION ALL SELECT 1.25e0 UNION ALL SELECT 1.5e0 UNION ALL SELECT 2e0 UNION ALL SELECT 3e0),
lists AS (SELECT n, q, <div(vec_id;8)> AS page, max(s) AS best, sum(s) AS total, min(r) AS seen FROM rk WHERE r <= 24 AND n < 64 GROUP BY n, q, <div(vec_id;8)>),
cell AS (SELECT n, q, page, a, seen, row_number() OVER (PARTITION BY n, a, q ORDER BY round(best + a * (total - best), 9) DESC, seen) AS rank FROM lists CROSS JOIN a),
fz AS (SELECT a, w, q, page, round(sum(CASE WHEN n = 16 THEN w ELSE 1e0 END / (60 + rank)), 12) AS rrf, min(seen + n) AS seen FROM cell CROSS JOIN w WHERE rank <= 20 GROUP BY a, w, q, page),
t AS (SELECT a, w, q, page, row_number() OVER (PARTITION BY a, w, q ORDER BY rrf DESC, seen, page) AS rank FROM fz),
grid AS (SELECT a, w, <long(sum(CASE WHEN g = 1 THEN 1 ELSE 0 END))> AS top1 FROM t LEFT JOIN gold ON t.q = gold.q AND t.page = gold.page WHERE rank = 1 GROUP BY a, w)"""
shared("ranking_sweep", f"WITH {OUT}, {SWEEP} SELECT a AS agreement, w AS lex_weight, top1, row_number() OVER (ORDER BY top1 DESC, a, w) = 1 AS best FROM grid", keep=(RK, "rk", mode_hits))
shared("parity_report", f"""WITH {OUT}, qq AS (SELECT DISTINCT q FROM rk), h AS (SELECT a.q, count(*) AS shared_hits, round(max(abs(a.s - b.s)), 9) AS max_delta, <long(sum(CASE WHEN a.r = b.r THEN 1 ELSE 0 END))> AS same_place, max(CASE WHEN a.r = 1 AND b.r = 1 THEN 1 ELSE 0 END) = 1 AS same_top1
FROM rk a JOIN rk b ON a.q = b.q AND a.vec_id = b.vec_id AND a.n = 64 AND b.n = 32 WHERE a.r <= 10 AND b.r <= 10 GROUP BY a.q)
SELECT qq.q AS query_id, coalesce(shared_hits, 0) AS shared_hits, max_delta, coalesce(same_place, 0) AS same_place, coalesce(same_top1, false) AS same_top1, coalesce(shared_hits, 0) = 10 AS same_set FROM qq LEFT JOIN h ON qq.q = h.q""", keep=(RK, "rk", mode_hits))
shared("missing_docs", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT DISTINCT doc_id FROM labels")
