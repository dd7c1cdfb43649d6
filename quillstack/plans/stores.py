"""Stored tables that are brought up to date: a vector index, postings in blocks, answers and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators import stored_postings as P
from ..operators import vector_store as X
from ..sources import merged
from ..sources.shared import folder
from .registry import query
from .retrieval import HITS, POST, TOPK, read, vector_queries

#: Vectors of a shard.
SHARD = 64


@query("index_refresh", f"""WITH {HITS}, s AS (SELECT count(DISTINCT vec_id // {SHARD}) AS shards, count(DISTINCT CASE WHEN vec_id // {SHARD} % 10 = 0 THEN vec_id // {SHARD} END) AS written FROM embeddings)
SELECT q * 50 AS query_id, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score, shards, written FROM hit, s WHERE rank <= 10""")
def index_refresh(spark, sf_dir):
    """An index is built, a tenth of its shards change, those alone are written anew, and all its lists are searched."""
    path = folder(spark, "index")
    now = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / SHARD).alias("shard"))
    X.refresh(now.withColumn("embedding", F.when(F.col("shard") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))), path)
    did = X.refresh(now, path)
    found = X.search(vector_queries(spark, sf_dir), path, 10)
    said = [F.lit(did[n]).cast("long").alias(n) for n in ("shards", "written")]
    return found.select(F.col("q").alias("query_id"), "rank", "vec_id", F.round("score", 6).alias("score"), *said)


@query("bm25_blocks", f"WITH {POST}{TOPK} SELECT q AS item_id, CAST(rank AS INT) AS rank, doc AS doc_id, round(score, 6) AS score FROM top WHERE rank <= 8")
def bm25_blocks(spark, sf_dir):
    """BM25's best from stored postings, of which blocks under the bar are not read."""
    index = P.build(read(spark, sf_dir, "documents"))
    got = P.search(index, L.query_terms(read(spark, sf_dir, "benchmark"), "item_id", "text"), 8)
    return got.select(F.col("q").alias("item_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("answers_merge", "SELECT conv_id AS n, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE turn = 0 OR conv_id % 10 = 3 GROUP BY conv_id")
def answers_merge(spark, sf_dir):
    """Stored answers: first each conversation's first turn, then a tenth of the conversations asked again."""
    path = folder(spark, "answers")
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "text", "turn")
    merged.merge(c.where("turn = 0"), path, "n")
    merged.merge(c.where("n % 10 = 3").withColumn("at", F.col("turn")), path, "n", latest="at")
    return merged.read(spark, path)


_KEY = "substr(sha256({0} || '|' || CAST(length({1}) AS VARCHAR) || '|m1'), 1, 20)"


@query("transcribe_merge", f"""WITH p AS (SELECT page_id, {_KEY.format('url', 'html')} AS page_key, {_KEY.format("url", "html || CASE WHEN page_id % 5 = 0 THEN 'old' ELSE '' END")} AS was FROM pages)
SELECT page_id, page_key, CASE WHEN page_id % 3 = 0 OR page_key <> was THEN 2 ELSE 1 END AS run FROM p""")
def transcribe_merge(spark, sf_dir):
    """Stored transcripts: two thirds of the pages, a fifth of them in an older form, then what is new or changed."""
    path = folder(spark, "transcripts")
    key = lambda html: F.substring(F.sha2(F.concat_ws("|", "url", F.char_length(html).cast("string"), F.lit("m1")), 256), 1, 20)
    pages = read(spark, sf_dir, "pages")
    old = F.concat("html", F.when(F.col("page_id") % 5 == 0, "old").otherwise(""))
    merged.merge(pages.where("page_id % 3 <> 0").select("page_id", key(old).alias("page_key"), F.lit(1).alias("run")), path, "page_id")
    now = pages.select("page_id", key(F.col("html")).alias("page_key"))
    todo = now.join(merged.read(spark, path).select("page_id", "page_key"), ["page_id", "page_key"], "left_anti")
    merged.merge(todo.withColumn("run", F.lit(2)), path, "page_id")
    return merged.read(spark, path)
