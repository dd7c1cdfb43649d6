"""The seven retrieval modes behind one call.  A question is a benchmark item beside the vector pair of its number; pages are
documents, and a vector's page counts as the document of its number."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators import lexical as L
from ..operators import router as R
from ..operators import vector as V
from ..sources.shared import few
from .judging import CROP, FACETS, FEW, SWEPT, expanded, questions, share, swept
from .registry import keep, query
from .retrieval import HYBRID, asked_terms, bm25, fused, hybrid, read, tok, vector_hits

POOL, PAGE_POOL = 24, 16


def _judged(spark, sf_dir, pool, n: int, chars: int):
    """(q, page, ord, raw) of the n first pages of ranked lists (q, page, rank), judged by so much of their texts."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.substring("text", 1, chars).alias("text"))
    asked = few(questions(spark, sf_dir), FEW)
    some = pool.where(F.col("rank") <= n).select("q", "page", F.col("rank").alias("ord")).join(asked.select("q"), "q", "left_semi")  # pools have other numbers too
    return J.OverlapJudge().score(docs.join(few(some, FEW), "page").join(asked, "q"))


def _variant_terms(spark, sf_dir):
    variants = J.expand(questions(spark, sf_dir), FACETS).select(F.struct("q", F.col("ord").alias("variant")).alias("v"), "variant")
    return L.query_terms(variants, "v", "variant")


def _expanded(spark, sf_dir, hit=None):
    """Each variant's best 20 documents, fused."""
    found = L.best(read(spark, sf_dir, "documents"), _variant_terms(spark, sf_dir), 20, hit=hit)
    return V.fuse(found.select("q.q", "q.variant", F.col("doc").alias("page"), "score", F.col("rank").alias("first")), ("q",))


def retrievers(spark, sf_dir):
    """By mode, what takes the numbers of pages and crops and gives (q, page, rank).  What several modes read is made once: the vectors' hits,
    the texts' counts of all questions' and variants' terms, and the fused lists."""
    hits = cache(lambda: vector_hits(spark, sf_dir))
    hit = cache(lambda: L.counted(read(spark, sf_dir, "documents"), asked_terms(spark, sf_dir).select("term").union(_variant_terms(spark, sf_dir).select("term"))))
    both = cache(lambda: keep("hybrid", hybrid(spark, sf_dir, hits(), hit())))
    lexical = lambda n: bm25(spark, sf_dir, n, hit()).select("q", F.col("doc").alias("page"), "rank")
    return {
        "visual": lambda pages, crops: fused(spark, sf_dir, hits()).select(F.col("g").alias("q"), "page", "rank"),
        "hybrid": lambda pages, crops: both(),
        "jev-expand": lambda pages, crops: _expanded(spark, sf_dir, hit()),
        "jev": lambda pages, crops: J.rerank(_judged(spark, sf_dir, lexical(POOL), POOL, CROP), pages),
        "jev+hybrid": lambda pages, crops: J.rerank(_judged(spark, sf_dir, both(), POOL, CROP), pages),
        "jev-page": lambda pages, crops: J.order_pages(_judged(spark, sf_dir, both(), PAGE_POOL, J.CLIP), place="ord"),
        "xray": lambda pages, crops: L.top(swept(spark, sf_dir, pages), pages, item="key", score="raw").withColumnRenamed("key", "page"),
    }


def _reranked(name: str, pool: str, chars: int, keep: str) -> str:
    """DuckDB: the pages of a list (q, page, ord), judged by their first characters."""
    text = f"substr(d.text, 1, {chars})"
    score = f"CASE WHEN trim({text}) <> '' THEN {share(tok('b.text'), tok(text))} END"
    return f"{name}s AS (SELECT q, page, ord, {score} AS s FROM ({pool}) p JOIN benchmark b ON b.item_id = q JOIN documents d ON d.doc_id = page), {name} AS (SELECT q, page, row_number() OVER (PARTITION BY q ORDER BY s DESC NULLS LAST, ord) AS rank FROM {name}s {keep})"


_ALL = f"""{HYBRID}, {expanded("text").replace("base AS", "xbase AS").replace("JOIN base", "JOIN xbase").replace(" t AS (", " xt AS (").replace(chr(10) + "t AS (", chr(10) + "xt AS (").replace("FROM t JOIN", "FROM xt t JOIN")}, {SWEPT.replace("it AS", "sit AS", 1).replace("FROM it)", "FROM sit)")},
vt AS (SELECT item_id AS q, ord, unnest({tok("variant")}) AS term FROM ex),
vs AS (SELECT q, ord, doc, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (SELECT avg(dl) FROM lens)))) AS score FROM vt JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc) GROUP BY q, ord, doc),
vk AS (SELECT *, row_number() OVER (PARTITION BY q, ord ORDER BY round(score, 9) DESC, doc) AS first FROM vs WHERE round(score, 9) > 0),
vn AS (SELECT q, ord, doc, first, score / max(score) OVER (PARTITION BY q, ord) AS norm FROM vk WHERE first <= 20),
vp AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY norm DESC, ord) AS pick FROM vn),
je AS (SELECT q, doc AS page, row_number() OVER (PARTITION BY q ORDER BY round(norm, 9) DESC, ord, first, doc) AS rank FROM vp WHERE pick = 1),
{_reranked("jc", f"SELECT q, doc AS page, rank AS ord FROM ltop WHERE rank <= {POOL}", CROP, "WHERE s IS NOT NULL")},
{_reranked("jh", f"SELECT q, page, rank AS ord FROM hy WHERE rank <= {POOL}", CROP, "WHERE s IS NOT NULL")},
{_reranked("jp", f"SELECT q, page, rank AS ord FROM hy WHERE rank <= {PAGE_POOL}", J.CLIP, "")},
xr AS (SELECT item_id AS q, doc_id AS page, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sw)"""
_UNION = " UNION ALL ".join(f"SELECT '{m}' AS mode, {q} AS query_id, page, CAST(rank AS INT) AS rank FROM {t} WHERE rank <= 4" for m, q, t in (("visual", "g", "fu"), ("hybrid", "q", "hy"), ("jev-expand", "q", "je"), ("jev", "q", "jc"), ("jev+hybrid", "q", "jh"), ("jev-page", "q", "jp"), ("xray", "q", "xr")))


@query("mode_pages", f"WITH {_ALL} {_UNION}")
def mode_pages(spark, sf_dir):
    """What each mode finds where nothing hinders any."""
    found = R.run_all(spark, (True, "on", True, True), retrievers(spark, sf_dir))
    return found.select("mode", F.col("q").alias("query_id"), "page", F.col("rank").cast("int").alias("rank"))


_SETTINGS = """SELECT s_suppkey, s_suppkey % 2 = 1 AS key, CASE s_suppkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'manual' WHEN 2 THEN 'on' END AS judge, s_suppkey % 3 <> 0 AS fuse, s_suppkey % 7 <> 0 AS texts,
CASE s_suppkey % 6 WHEN 0 THEN ' AUTO ' WHEN 1 THEN NULL WHEN 2 THEN 'Xray' WHEN 3 THEN 'jev+hybrid' WHEN 4 THEN 'best' ELSE '' END AS wish FROM supplier"""
_RULED = f"""st AS ({_SETTINGS}), ab AS (SELECT *, key AND coalesce(judge, 'on') <> 'off' AS able FROM st),
us AS (SELECT *, CASE WHEN able AND coalesce(judge, 'on') <> 'manual' THEN 'jev-page' WHEN fuse THEN 'hybrid' ELSE 'visual' END AS usual FROM ab),
md AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {a}, {r})" for m, a, r in R.MODES)}) v(mode, asks, reads))"""
_WHY = "CASE WHEN asks AND NOT key THEN 'judge: no key' WHEN asks AND NOT able THEN 'judge: off' WHEN reads AND NOT texts THEN 'pages: no texts' END"


def _settings(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    i = F.col("s_suppkey")
    judge = F.when(i % 5 == 0, "off").when(i % 5 == 1, "manual").when(i % 5 == 2, "on")
    wish = F.when(i % 6 == 0, " AUTO ").when(i % 6 == 2, "Xray").when(i % 6 == 3, "jev+hybrid").when(i % 6 == 4, "best").when(i % 6 == 5, "")
    return s.select("s_suppkey", (i % 2 == 1).alias("key"), judge.alias("judge"), (i % 3 != 0).alias("fuse"), (i % 7 != 0).alias("texts"), wish.alias("wish"))


@query("retrieval_modes", f"WITH {_RULED} SELECT s_suppkey, mode, {_WHY} AS hindrance, mode = usual AS usual FROM us CROSS JOIN md")
def retrieval_modes(spark, sf_dir):
    """Suppliers stand for deployments: which modes can run there, and which one is usual."""
    return R.offered(_settings(spark, sf_dir)).select("s_suppkey", "mode", "hindrance", "usual")


@query("mode_requests", f"""WITH {_RULED}, rq AS (SELECT *, CASE WHEN lower(trim(coalesce(wish, ''))) IN ('', 'auto', 'default') THEN usual ELSE lower(trim(wish)) END AS got FROM us)
SELECT s_suppkey, got AS mode, CASE WHEN md.mode IS NULL THEN 'unknown: ' || got ELSE {_WHY} END AS hindrance FROM rq LEFT JOIN md ON md.mode = rq.got""")
def mode_requests(spark, sf_dir):
    """What a deployment's request stands for, and what hinders it."""
    return R.resolved(_settings(spark, sf_dir)).select("s_suppkey", "mode", "hindrance")
