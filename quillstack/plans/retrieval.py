"""Lexical, vector and fused retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L
from ..operators import vector as V
from ..sources.tables import read
from .registry import keep, query

LIST = ", ".join(f"'{w}'" for w in T.STOP)


def folded(x: str) -> str:
    """DuckDB: lower, then without marks."""
    return f"translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


_STEMMED = f"CASE WHEN length(x) <= 4 OR regexp_full_match(x, '[0-9]+') THEN x ELSE regexp_replace(x, '{T.STEM}', '\\1') END"


def tok(x: str) -> str:
    """DuckDB: tokens of a text."""
    return f"list_transform(list_filter(regexp_extract_all({folded(x)}, '[0-9a-z]+'), lambda x: length(x) >= 2 AND x NOT IN ({LIST})), lambda x: {_STEMMED})"


POST = f"""tok AS (SELECT doc_id AS doc, {tok("text")} AS t FROM documents), lens AS (SELECT doc, CAST(len(t) AS BIGINT) AS dl FROM tok),
post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM lens) - count(*) + 5e-1) / (count(*) + 5e-1)) AS idf FROM post GROUP BY term),
qt AS (SELECT item_id AS q, unnest({tok("text")}) AS term FROM benchmark),
sc AS (SELECT q, doc, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (SELECT avg(dl) FROM lens)))) AS score
       FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc) GROUP BY q, doc)"""
TOPK = ", top AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM sc WHERE round(score, 9) > 0)"
#: DuckDB: vector hits at depth 24.  Query q is the row whose vec_id is 50 q, and there are as many as such rows.
HITS = """sc AS (SELECT a.vec_id // 50 AS q, b.vec_id, round(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9) AS score
       FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
hit AS (SELECT *, vec_id // 8 AS page, CAST(vec_id % 8 AS INT) AS chunk, CASE WHEN vec_id % 8 = 0 THEN 'page' ELSE 'region' END AS scale
       FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= 24)"""
PAGES = """pg AS (SELECT q, page, round(max(score) + 0.18e0 * (sum(score) - max(score)), 9) AS score, count(*) AS n_chunks,
       arg_min(CASE WHEN scale <> 'page' THEN chunk END, struct_pack(w := -score, r := rank)) FILTER (scale <> 'page') AS focus, min(rank) AS first FROM hit GROUP BY q, page)"""


def vector_queries(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


def vector_hits(spark, sf_dir, n=24):
    """The hits of every query; they are kept, for most plans read them several times."""
    found = V.nearest(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), n).drop("n")
    return keep("hits", V.with_chunks(found).withColumn("q", F.floor(F.col("q") / 50)))


def bm25(spark, sf_dir, k=8, hit=None):
    """`hit`: what `L.counted` gave for the questions' terms, where a plan has it already."""
    return L.best(read(spark, sf_dir, "documents"), asked_terms(spark, sf_dir), k, hit=hit)


def asked_terms(spark, sf_dir):
    return L.query_terms(read(spark, sf_dir, "benchmark"), "item_id", "text")


def asked_postings(spark, sf_dir):
    return L.query_postings(read(spark, sf_dir, "documents"), asked_terms(spark, sf_dir))


# --- lexical ---
@query("text_fold", f"SELECT doc_id, translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS folded FROM documents")
def text_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("text_stem", f"SELECT DISTINCT x AS word, {_STEMMED} AS stem FROM (SELECT unnest(regexp_extract_all({folded('text')}, '[0-9a-z]+')) AS x FROM documents)")
def text_stem(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(T.fold(F.lower("text")), F.lit("[0-9a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query("tokenise_docs", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenise_docs(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", T.tokenise(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("bm25_idf", f"WITH {POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    return L.idf(L.postings(read(spark, sf_dir, "documents"))).withColumn("idf", F.round("idf", 6))


@query("bm25_scores", f"WITH {POST} SELECT q AS item_id, doc AS doc_id, round(score, 6) AS score FROM sc")
def bm25_scores(spark, sf_dir):
    """Only the questions' terms are counted: no other token is shuffled or kept."""
    got = L.score_queries(read(spark, sf_dir, "documents"), L.query_terms(read(spark, sf_dir, "benchmark"), "item_id", "text"))
    return got.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {POST}{TOPK} SELECT q AS item_id, CAST(rank AS INT) AS rank, doc AS doc_id, round(score, 6) AS score FROM top WHERE rank <= 8")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir).select(F.col("q").alias("item_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("matched_terms", f"""WITH {POST}, t AS (SELECT item_id, term, min(i) AS i FROM (SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT item_id, {tok('text')} AS t FROM benchmark)) GROUP BY ALL)
SELECT item_id, string_agg(term, ' ' ORDER BY i) AS terms FROM t WHERE term IN (SELECT term FROM post) GROUP BY item_id""")
def matched_terms(spark, sf_dir):
    terms = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array_distinct(T.tokenise(F.col("text")))).alias("i", "term"))
    vocab = L.postings(read(spark, sf_dir, "documents")).select("term").distinct()
    kept = terms.join(vocab, "term", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("t"))
    return kept.select("item_id", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("terms"))


# --- vectors and pages ---
@query("vector_topk", f"WITH {HITS} SELECT q * 50 AS query_id, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score FROM hit WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return vector_hits(spark, sf_dir, 10).select((F.col("q") * 50).alias("query_id"), "rank", "vec_id", F.round("score", 6).alias("score"))


@query("hit_scale", f"WITH {HITS} SELECT q * 50 AS query_id, vec_id, page, chunk, scale FROM hit")
def hit_scale(spark, sf_dir):
    """Hits with their crops' scales, by a left join with the crop table: unknown crops are regions."""
    crops = V.with_chunks(read(spark, sf_dir, "embeddings").select("vec_id")).select("vec_id", "scale")
    found = vector_hits(spark, sf_dir).drop("scale").join(crops, "vec_id", "left")
    return found.select((F.col("q") * 50).alias("query_id"), "vec_id", "page", "chunk", F.coalesce("scale", F.lit("region")).alias("scale"))


@query("page_aggregate", f"WITH {HITS}, {PAGES} SELECT q AS query_id, page, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, first) AS INT) AS rank, round(score, 6) AS score, n_chunks, focus FROM pg")
def page_aggregate(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))
    return V.page_scores(vector_hits(spark, sf_dir)).select(F.col("q").alias("query_id"), "page", rank.alias("rank"), F.round("score", 6).alias("score"), "n_chunks", "focus")


# Two variants of a query: its vector, and that of the next id; their lists are fused.
FUSED = f"""{HITS}, {PAGES}, var AS (SELECT q // 2 AS g, q % 2 AS variant, page, score, first, n_chunks, focus FROM pg),
nm AS (SELECT *, score / CASE WHEN max(score) OVER (PARTITION BY g, variant) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY g, variant) END AS norm FROM var),
fu AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(norm, 9) DESC, variant, first, page) AS rank
       FROM (SELECT *, row_number() OVER (PARTITION BY g, page ORDER BY norm DESC, variant) AS pick FROM nm) WHERE pick = 1)"""


def fused(spark, sf_dir, found=None):
    """`found`: the hits, where a plan has them already; so below."""
    pages = V.page_scores(vector_hits(spark, sf_dir) if found is None else found).withColumn("g", F.floor(F.col("q") / 2)).withColumn("variant", F.pmod("q", F.lit(2)))
    return V.fuse(pages, ("g",))


@query("variant_fuse", f"WITH {FUSED} SELECT g AS query_id, page, variant, round(norm, 6) AS norm, CAST(rank AS INT) AS rank FROM fu")
def variant_fuse(spark, sf_dir):
    return fused(spark, sf_dir).select(F.col("g").alias("query_id"), "page", "variant", F.round("norm", 6).alias("norm"), "rank")


HYBRID = f"""{POST.replace("sc AS", "lsc AS").replace("FROM sc", "FROM lsc")}, ltop AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM lsc WHERE round(score, 9) > 0),
{FUSED}, lists AS (SELECT g AS q, page, rank, 0 AS list, 'visual' AS source FROM fu WHERE rank <= 20 UNION ALL SELECT q, doc, rank, 1, 'lexical' FROM ltop WHERE rank <= 20),
rr AS (SELECT q, page, round(sum(1e0 / (60 + rank)), 12) AS rrf, array_to_string(list_sort(list(source)), ',') AS sources, min(struct_pack(list, rank)) AS seen FROM lists GROUP BY q, page),
hy AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, seen, page) AS rank FROM rr)"""


def lists(spark, sf_dir, found=None, hit=None):
    visual = fused(spark, sf_dir, found).where("rank <= 20").select(F.col("g").alias("q"), "page", "rank", F.lit(0).alias("list"), F.lit("visual").alias("source"))
    lexical = bm25(spark, sf_dir, 20, hit).select("q", F.col("doc").alias("page"), "rank", F.lit(1).alias("list"), F.lit("lexical").alias("source"))
    return visual.unionByName(lexical).withColumn("weight", F.lit(1.0))


def hybrid(spark, sf_dir, found=None, hit=None):
    return V.rrf(lists(spark, sf_dir, found, hit))


@query("rrf_hybrid", f"WITH {HYBRID} SELECT q AS query_id, page, round(rrf, 9) AS rrf, sources, CAST(rank AS INT) AS rank FROM hy")
def rrf_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir).select(F.col("q").alias("query_id"), "page", F.round("rrf", 9).alias("rrf"), F.array_join("sources", ",").alias("sources"), "rank")


@query("retrieve_hybrid", f"WITH {HYBRID} SELECT q AS query_id, CAST(rank AS INT) AS rank, page, round(rrf, 9) AS rrf FROM hy WHERE rank <= 4")
def retrieve_hybrid(spark, sf_dir):
    """Variants, page roll-up, fusion, the best 20 with the lexical 20 by reciprocal ranks, the best 4."""
    return hybrid(spark, sf_dir).where("rank <= 4").select(F.col("q").alias("query_id"), "rank", "page", F.round("rrf", 9).alias("rrf"))


@query("page_ranking_score", f"""WITH {HYBRID} SELECT fu.g AS query_id, fu.page, round(coalesce(hy.rrf, fu.score), 9) AS ranking_score,
CASE WHEN hy.sources IS NULL THEN 'visual' WHEN hy.sources LIKE '%,%' THEN 'both' ELSE hy.sources END AS found_by FROM fu LEFT JOIN hy ON hy.q = fu.g AND hy.page = fu.page""")
def page_ranking_score(spark, sf_dir):
    found = vector_hits(spark, sf_dir)
    a = fused(spark, sf_dir, found).select(F.col("g").alias("query_id"), "page", "score")
    b = hybrid(spark, sf_dir, found).select(F.col("q").alias("query_id"), "page", "rrf", "sources")
    by = F.when(F.col("sources").isNull(), "visual").when(F.size("sources") > 1, "both").otherwise(F.element_at("sources", 1))
    return a.join(b, ["query_id", "page"], "left").select("query_id", "page", F.round(F.coalesce("rrf", "score"), 9).alias("ranking_score"), by.alias("found_by"))


BASE = f"{HITS}, base AS (SELECT q, page, min(rank) AS first FROM hit WHERE rank <= 12 GROUP BY q, page), bp AS (SELECT q, page, row_number() OVER (PARTITION BY q ORDER BY first) AS rank FROM base)"


def baseline(spark, sf_dir, k=4, found=None):
    from pyspark.sql import Window

    n = max(3 * k, 12)
    found = vector_hits(spark, sf_dir, n) if found is None else found.where(F.col("rank") <= n)
    pages = found.groupBy("q", "page").agg(F.min("rank").alias("first"))
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("first"))).where(F.col("rank") <= k)


@query("baseline_pages", f"WITH {BASE} SELECT q AS query_id, page, CAST(rank AS INT) AS rank FROM bp WHERE rank <= 4")
def baseline_pages(spark, sf_dir):
    return baseline(spark, sf_dir).select(F.col("q").alias("query_id"), "page", "rank")


ORDERED = "pr AS (SELECT q, page, row_number() OVER (PARTITION BY q ORDER BY score DESC, first) AS rank FROM pg)"


@query("oracle_union", f"""WITH {BASE}, {PAGES}, {ORDERED}, u AS (SELECT q, page, min(o) AS o FROM (SELECT q, page, rank AS o FROM bp WHERE rank <= 4 UNION ALL SELECT q, page, 100 + rank FROM pr WHERE rank <= 4) GROUP BY ALL)
SELECT q AS query_id, page, CAST(row_number() OVER (PARTITION BY q ORDER BY o) AS INT) AS rank FROM u""")
def oracle_union(spark, sf_dir):
    from pyspark.sql import Window

    found = vector_hits(spark, sf_dir)
    a = baseline(spark, sf_dir, found=found).select("q", "page", F.col("rank").alias("o"))
    b = ranked_pages(spark, sf_dir, found).where("rank <= 4").select("q", "page", (F.col("rank") + 100).alias("o"))
    u = a.unionByName(b).groupBy("q", "page").agg(F.min("o").alias("o"))
    return u.select(F.col("q").alias("query_id"), "page", F.row_number().over(Window.partitionBy("q").orderBy("o")).alias("rank"))


def ranked_pages(spark, sf_dir, found=None):
    from pyspark.sql import Window

    return V.page_scores(vector_hits(spark, sf_dir) if found is None else found).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first")))


@query("search_debug", f"""WITH {HITS}, {PAGES}, {ORDERED} SELECT pg.q AS query_id, count(*) AS n_pages, CAST(sum(n_chunks) AS BIGINT) AS n_chunks,
string_agg(CAST(pg.page AS VARCHAR), ' ' ORDER BY rank) FILTER (rank <= 5) AS top FROM pg JOIN pr USING (q, page) GROUP BY pg.q""")
def search_debug(spark, sf_dir):
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "page"))))
    got = ranked_pages(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n_pages"), F.sum("n_chunks").alias("n_chunks"), top.alias("top"))
    return got.select(F.col("q").alias("query_id"), "n_pages", "n_chunks", F.array_join(F.transform("top", lambda x: x["page"].cast("string")), " ").alias("top"))


@query("retrieval_funnel", f"""WITH {HYBRID}, k AS (SELECT q, page FROM hit) SELECT (SELECT count(*) FROM hit) AS hits, (SELECT count(DISTINCT vec_id) FROM hit) AS chunks,
(SELECT count(*) FROM (SELECT page FROM fu UNION SELECT page FROM lists)) AS pages, (SELECT count(DISTINCT q) FROM hit) AS calls""")
def retrieval_funnel(spark, sf_dir):
    found = vector_hits(spark, sf_dir)
    pages = fused(spark, sf_dir, found).select("page").unionByName(lists(spark, sf_dir, found).select("page")).agg(F.count_distinct("page").alias("pages"))
    sums = found.agg(F.count("*").alias("hits"), F.count_distinct("vec_id").alias("chunks"), F.count_distinct("q").alias("calls"))
    return sums.join(F.broadcast(pages)).select("hits", "chunks", "pages", "calls")


# Modes of a query pair: baseline (its first variant's), visual, hybrid (each one's best 4).
MODES = f"""{HYBRID}, base AS (SELECT q, page, min(rank) AS first FROM hit WHERE rank <= 12 GROUP BY q, page), bp AS (SELECT q, page, row_number() OVER (PARTITION BY q ORDER BY first) AS rank FROM base),
modes AS (SELECT 'baseline' AS mode, q // 2 AS q, page, rank FROM bp WHERE rank <= 4 AND q % 2 = 0 UNION ALL SELECT 'hybrid', q, page, rank FROM hy WHERE rank <= 4 UNION ALL SELECT 'visual', g, page, rank FROM fu WHERE rank <= 4)"""


def modes(spark, sf_dir):
    of = lambda df, name, q: df.where("rank <= 4").select(F.lit(name).alias("mode"), F.col(q).alias("q"), "page", "rank")
    found = vector_hits(spark, sf_dir)
    first = baseline(spark, sf_dir, found=found).where("q % 2 = 0").withColumn("g", F.floor(F.col("q") / 2))
    return of(first, "baseline", "g").unionByName(of(hybrid(spark, sf_dir, found), "hybrid", "q")).unionByName(of(fused(spark, sf_dir, found), "visual", "g"))


@query("mode_agreement", f"WITH {MODES} SELECT q AS query_id, page, count(*) AS n_modes, string_agg(mode, ',' ORDER BY mode) AS modes FROM modes GROUP BY q, page")
def mode_agreement(spark, sf_dir):
    return modes(spark, sf_dir).groupBy(F.col("q").alias("query_id"), "page").agg(F.count("*").alias("n_modes"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


@query("mode_compare", f"WITH {MODES} SELECT mode, q AS query_id, string_agg(CAST(page AS VARCHAR), ' ' ORDER BY rank) AS pages FROM modes GROUP BY mode, q")
def mode_compare(spark, sf_dir):
    got = modes(spark, sf_dir).groupBy("mode", F.col("q").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "page"))).alias("p"))
    return got.select("mode", "query_id", F.array_join(F.transform("p", lambda x: x["page"].cast("string")), " ").alias("pages"))


