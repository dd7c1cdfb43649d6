"""Index layout, question sets and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from ..sources import layout, questions
from .registry import query
from .retrieval import read

# Directories of tiles: some by number, some by name, and files between them.
_PATHS = """p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'index/tiles/x' || CAST(page_id AS VARCHAR(20)) || '.png.tiles' WHEN 1 THEN 'index/tiles/' || CAST(page_id AS VARCHAR(20)) || '.json' ELSE 'index/tiles/' || CAST(page_id AS VARCHAR(20)) || '.png.tiles' END AS path FROM pages)"""


@query("tile_listing", rf"WITH {_PATHS} SELECT path, CASE WHEN regexp_full_match(path, '.*/[0-9]+\.png\.tiles') THEN CAST(regexp_extract(path, '/([0-9]+)\.png', 1) AS INT) ELSE -1 END AS article_id FROM p WHERE path LIKE '%.png.tiles'")
def tile_listing(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("index/tiles/x"), i, F.lit(".png.tiles"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("index/tiles/"), i, F.lit(".json"))).otherwise(F.concat(F.lit("index/tiles/"), i, F.lit(".png.tiles")))
    return layout.tile_listing(read(spark, sf_dir, "pages").select(path.alias("path")))


@query("article_titles", """WITH a AS (SELECT source AS title, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS article_id FROM (SELECT DISTINCT source FROM documents))
SELECT vec_id, label AS article_id, coalesce(title, '?') AS title, printf('tiles/%d.png.tiles/tile_%04d.jpg', label, vec_id // 8) AS image FROM embeddings LEFT JOIN a ON a.article_id = label""")
def article_titles(spark, sf_dir):
    """Titles and page images of the vectors' articles; `?` past the last article."""
    from ..operators.ordinal import with_ordinal

    names, _ = with_ordinal(read(spark, sf_dir, "documents").select(F.col("source").alias("title")).distinct(), ["title"])
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("article_id"))
    got = layout.with_titles(rows, names.select(F.col("ordinal").cast("int").alias("article_id"), "title"))
    return got.select("vec_id", "article_id", "title", layout.page_image(F.col("article_id"), F.floor(F.col("vec_id") / 8)).alias("image"))


@query("article_sources", "SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN replace(url, chr(92), '/') END AS pdf FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'docs' || chr(92) || CAST(page_id AS VARCHAR) || '.PDF' ELSE url END AS url FROM pages)")
def article_sources(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("docs\\"), F.col("page_id").cast("string"), F.lit(".PDF"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", layout.source_pdf(url).alias("pdf"))


@query("blank_crops", r"SELECT page_id FROM (SELECT page_id, length(regexp_replace(html, '<[^>]*>|\s', '', 'g')) * 1e0 / nullif(length(html), 0) AS ink FROM pages) WHERE coalesce(ink, 1e0) >= 0.005e0")
def blank_crops(spark, sf_dir):
    """Pages that show something: their ink is the share of characters that are neither markup nor blank."""
    ink = F.char_length(F.regexp_replace("html", r"<[^>]*>|\s", "")) / F.nullif(F.char_length("html"), F.lit(0))
    return layout.without_blanks(read(spark, sf_dir, "pages").select("page_id", ink.alias("ink"))).select("page_id")


@query("existing_sources", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN pdf END AS pdf, coalesce(w, 0) AS page_width, coalesce(h, 0) AS page_height FROM (SELECT page_id, 'docs/' || CAST(page_id AS VARCHAR) || '.pdf' AS pdf FROM pages) LEFT JOIN (SELECT p_partkey, p_size * 40 AS w, p_size * 50 AS h FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = page_id")
def existing_sources(spark, sf_dir):
    """Sources that are still there, and sizes of pages where they are known."""
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(i, i.alias("article_id"), F.lit(0).alias("tile"), F.concat(F.lit("docs/"), i.cast("string"), F.lit(".pdf")).alias("pdf"))
    images = read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("article_id"), F.lit(0).alias("tile"), (F.col("p_size") * 40).alias("page_width"), (F.col("p_size") * 50).alias("page_height"))
    got = layout.with_sizes(layout.existing(rows, rows.where("page_id % 2 = 0").select(F.col("pdf").alias("path"))), images)
    return got.select("page_id", "pdf", "page_width", "page_height")


@query("image_fit_keys", "SELECT page_id, substr(sha256(url || '|' || CAST(page_id * 1000 AS VARCHAR) || '|' || CAST(length(html) AS VARCHAR) || '|' || CASE WHEN page_id % 2 = 0 THEN 'gemini|tiles|0|1' ELSE 'anthropic|long_edge|1568|0' END || '|0.85|90'), 1, 20) AS fit_key FROM pages")
def image_fit_keys(spark, sf_dir):
    policy = F.when(F.col("page_id") % 2 == 0, layout.fit_policy("gemini", "tiles", chase_tiles=True)).otherwise(layout.fit_policy("anthropic", "long_edge", 1568))
    return read(spark, sf_dir, "pages").select("page_id", layout.image_fit_key(F.col("url"), F.col("page_id") * 1000, F.char_length("html"), policy).alias("fit_key"))


@query("index_plan", "SELECT label, count(*) AS vectors, least(4096, greatest(1, count(*) // 40)) AS lists FROM embeddings GROUP BY label")
def index_plan(spark, sf_dir):
    return layout.index_plan(read(spark, sf_dir, "embeddings"), ["label"])


def question_rows(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select("item_id", F.col("text").alias("q"), F.when(i % 2 == 0, "price").otherwise("spec").alias("kind"), F.concat(F.lit('doc "'), i.cast("string"), F.lit('"')).alias("doc"),
                    F.transform(F.sequence(F.lit(1), (i % 3 + 1).cast("int")), lambda p: p).alias("pages"), F.when(i % 4 != 0, (i % 3 + 1).cast("int")).alias("primary"), (i % 4 != 0).alias("answerable"))


@query("question_set", r"""SELECT '- q: "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' || chr(10) || '  kind: ' || CASE WHEN item_id % 2 = 0 THEN 'price' ELSE 'spec' END || chr(10)
|| '  doc: "doc \"' || CAST(item_id AS VARCHAR) || '\""' || chr(10) || '  pages: [' || array_to_string(range(1, item_id % 3 + 2), ', ') || ']' || chr(10)
|| CASE WHEN item_id % 4 <> 0 THEN '  primary: ' || CAST(item_id % 3 + 1 AS VARCHAR) || chr(10) ELSE '' END || '  answerable: ' || CASE WHEN item_id % 4 <> 0 THEN 'true' ELSE 'false' END || chr(10) AS value FROM benchmark""")
def question_set(spark, sf_dir):
    """The YAML that the sink writes; tests read it back."""
    return questions.records(question_rows(spark, sf_dir))


@query("namespace_keys", "SELECT label, 'p|m|oneshot|ret:hybrid|k4|j1|' || substr(sha256(CAST(count(*) AS VARCHAR)), 1, 16) AS namespace FROM embeddings GROUP BY label")
def namespace_keys(spark, sf_dir):
    n = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").cast("string").alias("n"))
    return n.select("label", C.namespace_key("p", "m", "oneshot", "hybrid", 4, "j1", F.substring(F.sha2("n", 256), 1, 16)).alias("namespace"))


@query("cache_lookup", """WITH s AS (SELECT a.vec_id AS probe_id, b.vec_id AS entry_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND a.label % 2 = b.label % 2)
SELECT probe_id, arg_max(entry_id, (sim, -entry_id)) AS entry_id, round(max(sim), 6) AS similarity, max(sim) >= 0.95e0 AS served FROM s GROUP BY probe_id""")
def cache_lookup(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("namespace", F.col("label") % 2)
    got = C.lookup(e.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "entry"), e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "probe"))
    return got.select(F.col("probe").alias("probe_id"), F.col("entry").alias("entry_id"), F.round("similarity", 6).alias("similarity"), "served")


@query("cache_evict", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + (event_id % 100) * 3600000000 END, epoch_us(ts)) DESC, event_id) AS place FROM events) WHERE place <= 2000""")
def cache_evict(spark, sf_dir):
    """The 2,000 entries used or made last; of equals the earlier stays."""
    made = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), made.alias("created"), F.when(F.col("event_id") % 3 == 0, made + F.col("event_id") % 100 * F.lit(3600000000)).alias("last_used"))
    return C.kept(e).select(F.col("entry").alias("event_id"))


@query("question_provenance", r"""SELECT text AS q, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 'doc "' || CAST(item_id AS VARCHAR) || '"' END AS doc, item_id % 7 / 8e0 AS best, CASE WHEN item_id % 3 <> 0 THEN item_id % 4 / 4e0 END AS answerable, CAST(item_id % 3 AS INT) AS spilled, 'a, best: ' || CAST(item_id AS VARCHAR) AS source, 1 AS scope FROM benchmark""")
def question_provenance(spark, sf_dir):
    """A question set with its oracle's block, written as YAML and read back; the header is skipped."""
    from ..sources.shared import folder

    rows = question_rows(spark, sf_dir)
    i = F.col("item_id")
    block = F.struct((i % 7 / 8.0).alias("best"), F.when(i % 3 != 0, i % 4 / 4.0).alias("answerable"), F.lit(1.0).alias("scope"), (i % 3).cast("int").alias("spilled"), F.concat(F.lit("a, best: "), i.cast("string")).alias("from"))
    path = folder(spark, "questions")
    questions.write(rows.withColumn("doc", F.when(i % 5 != 0, F.col("doc"))).withColumn("oracle", block).drop("item_id"), path)
    got = questions.read(spark, path)
    return got.select("q", "doc", "oracle.best", "oracle.answerable", "oracle.spilled", F.col("oracle.from").alias("source"), F.col("oracle.scope").cast("int").alias("scope"))
