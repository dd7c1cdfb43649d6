"""Sources, sinks, accounting and event-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sidecar as SIDE
from ..operators.ordinal import with_ordinal
from ..streaming import events as S
from .mining import _REV as DATED
from .mining import ANY_FAMILY, dated
from .registry import query, shared
from .retrieval import read

_SCAN = "SELECT <long(row_number() OVER (ORDER BY source) - 1)> AS article_id, source AS title, replace('docs' || chr(92) || source || '.pdf', chr(92), '/') AS url, n_pages FROM (SELECT source, count(*) AS n_pages FROM documents GROUP BY source) s"


@query("article_scan", _SCAN)
def article_scan(spark, sf_dir):
    """Articles in order of their titles, numbered by ranges and not in one task."""
    n = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("title")).agg(F.count("*").alias("n_pages"))
    rows, _ = with_ordinal(n, ["title"])
    url = F.replace(F.concat(F.lit("docs\\"), "title", F.lit(".pdf")), F.lit("\\"), F.lit("/"))
    return rows.select(F.col("ordinal").alias("article_id"), "title", url.alias("url"), "n_pages")


# The last of duplicate chunks stays; without a scale, crop 0 is the page's; an unknown crop is a region.
shared("chunk_scale_lookup", """WITH m AS (SELECT label AS article, <div(vec_id;8)> AS tile, vec_id % 8 AS chunk, vec_id, CASE WHEN vec_id % 5 = 0 THEN 'region' WHEN vec_id % 5 = 1 THEN 'page' END AS scale FROM embeddings UNION ALL SELECT label, <div(vec_id;8)>, vec_id % 8, vec_id + 1000000, 'page' FROM embeddings WHERE vec_id % 40 = 0),
k AS (SELECT tile, chunk, coalesce(scale, CASE WHEN chunk = 0 THEN 'page' ELSE 'region' END) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY tile, chunk ORDER BY vec_id DESC) AS pick FROM m) x WHERE pick = 1)
SELECT e.vec_id, coalesce(k.scale, 'region') AS scale FROM embeddings e LEFT JOIN k ON k.tile = <div(e.vec_id;8)> AND k.chunk = e.vec_id % 8 + CASE WHEN e.vec_id % 17 = 0 THEN 100 ELSE 0 END""")
shared("stale_tiles", """WITH rec AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '#old' WHEN page_id % 4 = 1 THEN NULL ELSE url END AS source FROM pages WHERE page_id % 6 <> 0)
SELECT p.page_id, r.page_id IS NULL AS missing FROM pages p LEFT JOIN rec r ON p.page_id = r.page_id WHERE r.page_id IS NULL OR r.source IS NULL OR r.source <> p.url""")
_DATED_REV = r"""CASE WHEN regexp_extract(text, 'CBG/PL-PLN/([0-9]{2}\.[0-9]{2}\.[0-9]{4})', 1) <> '' THEN strftime(strptime(regexp_extract(text, 'CBG/PL-PLN/([0-9]{2}\.[0-9]{2}\.[0-9]{4})', 1), '%d.%m.%Y'), '%Y-%m-%d')
WHEN regexp_extract(substr(text, 1, 400), '[0-9]{2}\.[0-9]{2}\.[0-9]{4}') <> '' THEN strftime(strptime(regexp_extract(substr(text, 1, 400), '[0-9]{2}\.[0-9]{2}\.[0-9]{4}'), '%d.%m.%Y'), '%Y-%m-%d') END"""
_SIDE = f"""{DATED}, side AS (SELECT source AS title, documents.doc_id AS page, d.text, length(trim(d.text, chr(32) || chr(9) || chr(10) || chr(13))) < {SIDE.BLIND_CHARS} AS visual_only, {_DATED_REV.replace('text', 'd.text')} AS revision FROM documents JOIN d ON d.doc_id = documents.doc_id)"""


@query("text_sidecar", f"WITH {_SIDE} SELECT * FROM side")
def text_sidecar(spark, sf_dir):
    """Documents with a date line before some; their revision is that date."""
    d = read(spark, sf_dir, "documents").withColumn("text", dated("text"))
    return SIDE.build(d, "source", "doc_id", "text")


@query("sidecar_report", f"""WITH {_SIDE}, r AS (SELECT title, count(*) AS pages, count(*) FILTER (visual_only) AS visual_only, count(DISTINCT revision) AS revisions, max(revision) AS newest FROM side GROUP BY title),
k AS (SELECT source AS title, sum(greatest(1, n_chars // 640)) AS chunks, sum(n_chars % 7) AS blanks FROM documents WHERE source <> 'src3' GROUP BY source) SELECT r.*, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, CAST(coalesce(blanks, 0) AS BIGINT) AS blanks FROM r LEFT JOIN k USING (title)""")
def sidecar_report(spark, sf_dir):
    """Pages, revisions and chunks of each title; one title has no manifests."""
    m = read(spark, sf_dir, "documents").where("source <> 'src3'").select(F.col("source").alias("title"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 640)).alias("num_chunks"), (F.col("n_chars") % 7).alias("blank_skipped"))
    return SIDE.with_chunks(SIDE.report(text_sidecar(spark, sf_dir)), m)


@query("answers_upsert", """SELECT conv_id AS n, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def answers_upsert(spark, sf_dir):
    """Each conversation's first turn is what was there; the last of its later turns replaces it."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn", "text")
    first = c.groupBy("n").agg(F.min("turn").alias("turn"))
    old = c.join(first, ["n", "turn"]).select("n", "text")
    new = c.join(first, ["n", "turn"], "left_anti").groupBy("n").agg(F.max_by("text", "turn").alias("text"))
    return SIDE.upsert(old, new, "n")


shared("transcribe_todo", """WITH k AS (SELECT page_id, substr(<sha(url || '|' || CAST(length(html) AS VARCHAR(20)) || '|m1')>, 1, 20) AS k FROM pages), done AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN k ELSE substr(k, 2) END AS k FROM k WHERE page_id % 2 = 0)
SELECT k.page_id, k.k AS page_key FROM k LEFT JOIN done ON k.page_id = done.page_id AND k.k = done.k WHERE done.page_id IS NULL""")
shared("preamble", """WITH p AS (SELECT conv_id, turn, '  • strona ' || CAST(turn AS VARCHAR(9)) || ' — ' || role AS line FROM conversations) SELECT conv_id, 'Pytanie: ' || CAST(conv_id AS VARCHAR(9)) || chr(10) || <agg(line;chr(10);turn)> AS preamble FROM p GROUP BY conv_id""")
shared("cost_rollup", """SELECT event_type, count(*) AS calls, <long(sum(event_id % 1000))> AS tokens_in, <long(sum(event_id % 77))> AS tokens_out,
round(sum(event_id % 1000) * 0.042e0 / 1e6, 9) AS judge_cost, round((sum(event_id % 1000) * 5e0 + sum(event_id % 50) * 0.5e0 + sum(event_id % 77) * 2.5e1) / 1e6, 6) AS reader_cost FROM events GROUP BY event_type""")
# Streamed chunks are cumulative: the last that isn't zero counts; agent steps add up.
shared("usage_fold", """WITH s AS (SELECT user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 500 END AS used, event_id FROM events),
l AS (SELECT user_id, event_type, used, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS back FROM s WHERE used <> 0)
SELECT s.user_id, <long(sum(CASE WHEN s.event_type = 'click' THEN s.used ELSE 0 END))> AS additive, <long(max(coalesce(l.used, 0)))> AS cumulative FROM s LEFT JOIN l ON s.user_id = l.user_id AND l.event_type = 'view' AND back = 1 GROUP BY s.user_id""")
shared("token_ratio", "WITH t AS (SELECT source, n_chars / 4e0 AS transcript, 1032e0 + doc_id % 3 * 258 AS image FROM documents) SELECT source, round(avg(transcript / image), 9) AS mean_ratio, round(sum(transcript) / sum(image), 9) AS total_ratio, sum(transcript) < sum(image) AS cheaper FROM t GROUP BY source")
shared("answer_quality", f"""WITH r AS (SELECT conv_id, {ANY_FAMILY} AS family, count(*) AS cites, <long(sum(CASE WHEN length(text) > 100 THEN 1 ELSE 0 END))> AS verified, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 2 = 0 END AS on_gold FROM conversations GROUP BY conv_id)
SELECT <long(sum(CASE WHEN on_gold THEN 1 ELSE 0 END))> AS on_gold, <long(sum(CASE WHEN on_gold IS NOT NULL THEN 1 ELSE 0 END))> AS scored, <long(sum(CASE WHEN cites > 0 THEN 1 ELSE 0 END))> AS cited, <long(sum(CASE WHEN cites = verified THEN 1 ELSE 0 END))> AS all_verified, <long(sum(family))> AS named_a_family, count(*) AS n FROM r""")


@query("delta_fold", """WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'TATY--- ' ELSE '' END || text || CASE WHEN turn % 4 = 2 THEN '---CY' ELSE '' END AS t FROM conversations),
a AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS t FROM d GROUP BY conv_id) SELECT conv_id, string_split(t, '---CYTATY---')[1] AS shown FROM a""")
def delta_fold(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = F.concat(F.when(F.col("turn") % 4 == 3, "TATY--- ").otherwise(""), "text", F.when(F.col("turn") % 4 == 2, "---CY").otherwise(""))
    return S.fold_deltas(c.select("conv_id", "turn", t.alias("delta")), "conv_id", "turn", "delta").withColumnRenamed("answer", "shown")


shared("cache_replay", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT user_id, <long(step)> AS step, event_type AS type, true AS cached, 0 AS tokens FROM r""")


@query("events_by_window", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_by_window(spark, sf_dir):
    """Extension: the batch result of the streaming windows."""
    return S.windowed(read(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 6))


