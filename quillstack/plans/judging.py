"""Judge stages over texts, with the deterministic judge of `quillstack.operators.judge`: a query's share of
terms found in a text.  Questions are benchmark items, pages are documents, crops the first part of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators import lexical as L
from ..operators import shards
from ..sources.shared import few, stored
from .mining import PHRASE
from .registry import keep, query, shared, spark_sql
from .retrieval import POST, TOPK, asked_postings, asked_terms, bm25, read, tok
from .statistics import OUT, RK, mode_hits

# Facets that a question may ask for.
FACETS = ["cena koszt cennik price cost pricing", "wymiary szerokość wysokość dimensions width height", "montaż instalacja installation assembly",
          "parametry techniczne specyfikacja technical specifications", "opcje akcesoria wyposażenie options accessories", "bezpieczeństwo zabezpieczenia safety security"]
CROP = 1500
#: Candidates and questions that are broadcast at most.
FEW = 100_000
FACET = "fc AS (" + " UNION ALL ".join(f"SELECT {i} AS facet, '{f}' AS name" for i, f in enumerate(FACETS)) + ")"
# Every third item names a facet, every other third an opening.
ASKED = f"CASE item_id % 3 WHEN 0 THEN text || ' {FACETS[0]}' WHEN 1 THEN 'Ile kosztuje ' || text || ' {FACETS[2]}' ELSE text END"


def share(question: str, text: str) -> str:
    """DuckDB: share of the question's distinct tokens that the text has."""
    return f"len(list_intersect(list_distinct({question}), {text})) * 1e0 / greatest(len(list_distinct({question})), 1)"


def questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("query"))


def candidates(spark, sf_dir, k, hit=None):
    """(q, query, doc, ord, retrieval_score, text) of the k best pages of each question."""
    pool = bm25(spark, sf_dir, k, hit).select("q", "doc", F.col("rank").alias("ord"), F.col("score").alias("retrieval_score"))
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return pages.join(few(pool, FEW), "doc").join(few(questions(spark, sf_dir), FEW), "q")


CANDIDATES = f"{POST}{TOPK}, cand AS (SELECT q, doc, rank AS ord, score AS s, b.text AS query, d.text AS page FROM top JOIN benchmark b ON b.item_id = q JOIN documents d ON d.doc_id = doc"


def expanded(text: str) -> str:
    """DuckDB: own, base and t, of which the variants of the items' question `text` are made, and ex (item_id, ord, variant)."""
    return f"""{FACET}, ask AS (SELECT item_id AS conv_id, 0 AS turn, {text} AS text FROM benchmark), {PHRASE},
s AS (SELECT conv_id, text, phrase, facet, name, {share(tok("name"), tok("text"))} AS score FROM np CROSS JOIN fc),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, facet) AS place FROM s),
own AS (SELECT conv_id, 0 AS ord, trim(text, chr(32) || chr(10)) AS variant, length(phrase) >= 3 AS more FROM np UNION ALL SELECT conv_id, 1, phrase, true FROM np WHERE length(phrase) >= 3),
base AS (SELECT conv_id, max(ord) AS last, arg_max(variant, ord) AS base FROM own GROUP BY conv_id),
ex AS (SELECT conv_id AS item_id, CAST(ord AS INT) AS ord, variant FROM own UNION ALL SELECT t.conv_id, CAST(last + place AS INT), base || ' ' || name FROM t JOIN base USING (conv_id) WHERE place <= 2 AND score >= 0.7e0)"""


@query("facet_expand", f"WITH {expanded(ASKED)} SELECT * FROM ex")
def facet_expand(spark, sf_dir):
    """The question stays first; facets go behind its last local variant."""
    i = F.col("item_id") % 3
    text = F.when(i == 0, F.concat("text", F.lit(" " + FACETS[0]))).when(i == 1, F.concat(F.lit("Ile kosztuje "), "text", F.lit(" " + FACETS[2]))).otherwise(F.col("text"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), text.alias("query"))
    return J.expand(asked, FACETS).withColumnRenamed("q", "item_id")


POOL = f"""{OUT}, cand AS (SELECT q, vec_id, s, 64 - n AS list, r FROM rk WHERE r <= 24),
one AS (SELECT *, row_number() OVER (PARTITION BY q, vec_id ORDER BY list, r) AS pick FROM cand),
pool AS (SELECT q, vec_id, s, row_number() OVER (PARTITION BY q ORDER BY list, r) AS ord, count(*) OVER (PARTITION BY q) AS candidates FROM one WHERE pick = 1)"""
#: The best 20 documents by BM25 come behind the vectors' lists; a document is its page's first crop.
HPOOL = """, lx AS (SELECT q, doc * 8 AS vec_id, rank AS r FROM lexical_top WHERE rank <= 20), cand AS (SELECT q, vec_id, s, 64 - n AS list, r FROM rk WHERE r <= 24 UNION ALL SELECT q, vec_id, 0e0 AS s, 99 AS list, r FROM lx WHERE r <= 20),
one AS (SELECT *, row_number() OVER (PARTITION BY q, vec_id ORDER BY list, r) AS pick FROM cand),
pool AS (SELECT q, vec_id, s, row_number() OVER (PARTITION BY q ORDER BY list, r) AS ord, count(*) OVER (PARTITION BY q) AS candidates FROM one WHERE pick = 1)"""
shared("candidate_pool", f"WITH {POOL} SELECT q AS query_id, <long(ord)> AS ord, vec_id, round(s, 6) AS score, candidates FROM pool WHERE ord <= 64", keep=(RK, "rk", mode_hits))
shared("candidate_pool_hybrid", f"WITH {HPOOL} SELECT q AS query_id, <long(ord)> AS ord, vec_id, round(s, 6) AS score, candidates FROM pool WHERE ord <= 64", keep=(RK, "rk", mode_hits))
_POOLED = " SELECT q AS query_id, <long(ord)> AS ord, vec_id, round(s, 6) AS score, candidates FROM pool WHERE ord <= 64"


@query("candidate_pool_hybrid", f"WITH {POST}{TOPK}, lexical_top AS (SELECT q, doc, rank FROM top), {OUT.replace('sc AS', 'vsc AS').replace('FROM sc)', 'FROM vsc)')}{HPOOL}{_POOLED}")
def candidate_pool_hybrid(spark, sf_dir):
    bm25(spark, sf_dir, 20).select("q", "doc", "rank").createOrReplaceTempView("lexical_top")
    keep("rk", mode_hits(spark, sf_dir)).createOrReplaceTempView("mode_hits")  # the text reads it several times
    return spark_sql(spark, sf_dir, f"WITH rk AS (SELECT * FROM mode_hits){HPOOL}{_POOLED}")


shared("judge_validate", """WITH raw AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'nan' WHEN 1 THEN '-1' WHEN 2 THEN '4' WHEN 3 THEN 'true' WHEN 4 THEN '2' WHEN 5 THEN '2.5' END AS said FROM events),
v AS (SELECT event_id, said, CASE WHEN <like(said;'^-?[0-9]+(\\.[0-9]+)?$')> THEN try_cast(said AS DOUBLE) END AS x FROM raw)
SELECT event_id, said, CASE WHEN x >= 0 AND x <= 3 THEN x END AS score FROM v""".replace("\\\\", "\\"))


@query("judge_rerank", f"""WITH {CANDIDATES} WHERE rank <= 24), w AS (SELECT *, string_split(coalesce(page, ''), ' ') AS w FROM cand), k AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(w) - {J.STRIP}) / {J.STEP}e0)) AS BIGINT) + 1)) AS crop FROM w),
c AS (SELECT q, doc, ord, s, crop, query, substr(array_to_string(list_slice(w, crop * {J.STEP} + 1, crop * {J.STEP} + {J.STRIP}), ' '), 1, {J.CLIP}) AS text FROM k),
j AS (SELECT *, CASE WHEN trim(text) <> '' THEN {share(tok("query"), tok("text"))} END AS score FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY round(3 * score, 9) DESC NULLS LAST, crop) AS pick FROM j)
SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, ord) AS INT) AS rank, doc AS doc_id, CAST(crop AS INT) AS crop, round(score, 6) AS score, round(s, 6) AS retrieval_score, false AS fell FROM b WHERE pick = 1 AND score IS NOT NULL""")
def judge_rerank(spark, sf_dir):
    """Each candidate page by its best crop; an invalid score would put the search's order back."""
    scored = J.OverlapJudge().score(J.crop_texts(candidates(spark, sf_dir, 24)))
    got = J.rerank(J.best_crops(scored, ["q", "doc"]), 24)
    return got.select(F.col("q").alias("query_id"), "rank", F.col("doc").alias("doc_id"), "crop", F.round("score", 6).alias("score"), F.round("retrieval_score", 6).alias("retrieval_score"), "fell")


@query("page_rerank", f"""WITH {CANDIDATES} WHERE rank <= 16), j AS (SELECT *, CASE WHEN trim(page) <> '' THEN {share(tok("query"), tok(f"substr(page, 1, {J.CLIP})"))} END AS score FROM cand)
SELECT q AS query_id, doc AS doc_id, CAST(ord AS INT) AS prior, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, ord) AS INT) AS rank FROM j""")
def page_rerank(spark, sf_dir):
    """Whole pages, up to what is judged of one."""
    got = J.order_pages(J.OverlapJudge().score(candidates(spark, sf_dir, 16)), place="ord")
    return got.select(F.col("q").alias("query_id"), F.col("doc").alias("doc_id"), F.col("ord").alias("prior"), F.round("score", 6).alias("score"), "rank")


@query("gate_verdict", f"""WITH {CANDIDATES} WHERE rank <= 4), best AS (SELECT q, round(max({share(tok("query"), tok(f"substr(page, 1, {J.CLIP})"))}), 4) AS answerable FROM cand GROUP BY q),
w AS (SELECT item_id AS q, unnest(list_distinct({tok("text")})) AS term FROM benchmark), sp AS (SELECT q, round(avg(CASE WHEN term IN (SELECT term FROM post) THEN 1e0 ELSE 0e0 END), 4) AS scope FROM w GROUP BY q)
SELECT q AS item_id, answerable, scope, CASE WHEN scope < 0.5e0 THEN 'out-of-scope' WHEN answerable < 0.3e0 THEN 'not-in-corpus' ELSE 'ok' END AS verdict FROM sp LEFT JOIN best USING (q)""")
def gate_verdict(spark, sf_dir):
    """Is the answer on the four best pages, and are the question's terms the corpus's?"""
    hit = L.counted(read(spark, sf_dir, "documents"), asked_terms(spark, sf_dir))  # one pass over the texts tells both
    scored = J.OverlapJudge().score(candidates(spark, sf_dir, 4, hit))
    scope = J.known_scope(questions(spark, sf_dir), hit.known() if hit else asked_postings(spark, sf_dir).select("term").distinct())
    return J.gate(scored, scope).withColumnRenamed("q", "item_id")


# Costs in seventeenths of a token, so that they are whole: 1.7 characters are a token, and a page's question 48.
SHARDS = """o AS (SELECT source, doc_id, least(length(coalesce(text, '')), 6000) * 10 + 816 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, i, CAST(0 AS BIGINT) AS shard, cost AS size FROM o WHERE i = 1 UNION ALL
SELECT o.source, o.doc_id, o.i, CASE WHEN f.size + o.cost > 816000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.size + o.cost > 816000 THEN o.cost ELSE f.size + o.cost END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)"""
SWEPT = f"""it AS (SELECT item_id, list_distinct({tok("text")}) AS t FROM benchmark), qw AS (SELECT item_id, len(t) AS m, unnest(t) AS term FROM it),
dw AS (SELECT doc_id, unnest(list_distinct({tok(f"substr(text, 1, {J.CLIP})")})) AS term FROM documents), sw AS (SELECT item_id, doc_id, count(*) * 1e0 / max(m) AS score FROM qw JOIN dw USING (term) GROUP BY ALL)"""


def swept(spark, sf_dir, most=None):
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return J.OverlapJudge().sweep(questions(spark, sf_dir), pages, most)


@query("shard_plan", f"WITH RECURSIVE {SHARDS} SELECT source, doc_id, shard FROM f")
def shard_plan(spark, sf_dir):
    cost = F.least(F.char_length(F.coalesce("text", F.lit(""))), F.lit(J.CLIP)) * 10 + 816
    return shards.plan(read(spark, sf_dir, "documents").select("source", "doc_id", cost.alias("cost")), "source", "doc_id", 816_000)


@query("xray_rank", f"WITH {SWEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sw) SELECT item_id, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def xray_rank(spark, sf_dir):
    """The ten best pages of the sweep; ties keep the corpus's order."""
    best = L.top(swept(spark, sf_dir, 10), 10, item="key", score="raw")
    return best.select(F.col("q").alias("item_id"), "rank", F.col("key").alias("doc_id"), F.round(F.col("raw") / 3, 6).alias("score"))


@query("facet_fold", f"""WITH RECURSIVE {SHARDS}, {SWEPT}, e AS (SELECT item_id, source, shard, max(score) AS best FROM sw JOIN f USING (doc_id) GROUP BY ALL)
SELECT item_id, round(max(best), 4) AS answerable, count(*) AS shards FROM e GROUP BY item_id""")
def facet_fold(spark, sf_dir):
    """Evidence of each shard, folded by the largest."""
    # A shard is told by a text, which no other has: pages are swept under their shard's, and what is found need not be joined.
    name = F.to_json(F.struct("source", "shard"))
    of = shard_plan(spark, sf_dir).select("doc_id", name.alias("key"))
    pages = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, J.CLIP).alias("text"))
    pages = pages.join(of.hint("shuffle_hash"), "doc_id").select("key", "text")
    return J.fold_shards(J.OverlapJudge().sweep(questions(spark, sf_dir), pages)).withColumnRenamed("q", "item_id")


@query("order_drift", f"""WITH {CANDIDATES} WHERE rank <= 24), j AS (SELECT q, ord, 3 * {share(tok("query"), tok(f"substr(page, 1, {J.CLIP})"))} AS fwd, 3 * {share(tok("query"), tok(f"substr(page, 1, {CROP})"))} AS rev FROM cand WHERE trim(substr(page, 1, {CROP})) <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(fwd, 9) DESC, ord) AS f, row_number() OVER (PARTITION BY q ORDER BY round(rev, 9) DESC, ord) AS r, abs(fwd - rev) AS moved FROM j)
SELECT q AS query_id, count(*) AS n, round(avg(moved), 6) AS mean_drift, round(max(moved), 6) AS max_drift, count(*) FILTER (f = 1 AND r = 1) = 1 AS top1_stable, least(count(*), 3) = count(*) FILTER (f <= 3 AND r <= 3) AS top3_stable FROM p GROUP BY q""")
def order_drift(spark, sf_dir):
    """Each question's candidates judged twice: by their pages, and by their first parts with the rubric turned round."""
    pairs = stored(candidates(spark, sf_dir, 24).select("q", "query", F.col("doc").alias("key"), "ord", "text"), "drift-pairs")  # read twice
    judge = J.OverlapJudge()
    return J.order_drift(pairs, judge, J.Mirrored(judge, CROP)).withColumnRenamed("q", "query_id")
