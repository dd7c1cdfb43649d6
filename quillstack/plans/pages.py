"""Cache, citation and page-geometry queries, and the sequential alignment of quotes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cite_tokens
from ..operators import citations as C
from .registry import query, shared
from .retrieval import T, read

shared("worth_caching", """WITH r AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS answered, max(CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END) AS refused, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS tile FROM events GROUP BY user_id)
SELECT user_id, answered = 1 AND refused = 0 AND tile = 1 AS worth FROM r""")
shared("index_fingerprint", "WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label) SELECT label, substr(<sha(CAST(n AS VARCHAR(20)) || '|' || CAST(lo AS VARCHAR(20)) || '|' || CAST(hi AS VARCHAR(20)))>, 1, 16) AS fingerprint FROM s")
# Answers with a citation block, of good and bad lines.
CITED = r"""cited AS (SELECT conv_id, turn, replace(text, '"', '') || '---CYTATY---~ `{"page": ' || CAST(conv_id % 10 AS VARCHAR(9)) || ', "quote": "' || substr(replace(replace(replace(text, chr(10), ' '), '"', ''), '\', ''), 1, 30) || '", "article_id": ' || CAST(turn % 3 AS VARCHAR(9)) || '}`~not json~{"page": 4}~{"page": 5, "quote": ""}~{"page": ' AS a FROM conversations WHERE role <> 'user')"""
SPLIT = CITED.replace("'\\'", "chr(92)") + r""", body AS (SELECT conv_id, turn, <at(<part(a;'---CYTATY---')>;1)> AS answer, <at(<part(a;'---CYTATY---')>;2)> AS block FROM cited),
ln AS (SELECT conv_id, turn, <unnest(<part(block;'~')>)> AS raw FROM body), st AS (SELECT conv_id, turn, <trim(raw;' `')> AS s FROM ln),
cite AS (SELECT conv_id, turn, try_cast(<json(s;page)> AS INT) AS page, <json(s;quote)> AS quote, try_cast(<json(s;article_id)> AS INT) AS article FROM st WHERE s LIKE '{%' AND <json(s;quote)> <> '')"""
shared("citation_split", f"WITH {SPLIT} SELECT conv_id, turn, page, quote, article FROM cite")
shared("citation_resolve", f"""WITH {SPLIT}, att AS (SELECT a.conv_id, a.turn, doc_id, doc_id % 3 AS article, doc_id % 10 AS page, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY doc_id) AS rank FROM body a JOIN (SELECT doc_id, doc_id % n AS conv FROM documents CROSS JOIN (SELECT max(conv_id) + 1 AS n FROM conversations) c) d ON d.conv = a.conv_id),
m AS (SELECT c.conv_id, c.turn, c.page, doc_id, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY rank) AS pick FROM cite c JOIN att a ON a.conv_id = c.conv_id AND a.turn = c.turn AND a.page = c.page AND (c.article IS NULL OR c.article = a.article))
SELECT conv_id, turn, page, doc_id FROM m WHERE pick = 1""")


@query("cite_tokens", f"SELECT conv_id, turn, coalesce(array_to_string(regexp_extract_all(lower(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}')), '[0-9a-z]+'), ' '), '') AS tokens FROM conversations")
def cite_tokens_query(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(cite_tokens(F.col("text")), " ").alias("tokens"))


# Pins of an order: a column neighbour above and a row neighbour to the left confirm one.
shared("pin_confirm", """WITH pin AS (SELECT l_orderkey, l_linenumber, l_quantity % 4 AS x, l_linenumber % 3 * 2e0 AS y FROM lineitem),
c AS (SELECT a.l_orderkey, a.l_linenumber, max(CASE WHEN abs(a.x - b.x) < 1.5e0 AND b.y < a.y - 1.5e0 THEN 1 ELSE 0 END) AS col, max(CASE WHEN abs(a.y - b.y) < 1.5e0 AND b.x < a.x - 1.5e0 THEN 1 ELSE 0 END) AS row_ FROM pin a JOIN pin b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey, a.l_linenumber)
SELECT l_orderkey, l_linenumber, col = 1 AND row_ = 1 AS confirmed FROM c""")
# Page sizes in pixels from parts; strips of 1024 every 640, the last one pinned to the edge; columns of 875.
SIZE = "size AS (SELECT p_partkey, <int(600 + p_size * 40)> AS w, <int(700 + (p_partkey * 37) % 2400)> AS h FROM part)"
GRID = f"""{SIZE}, yi AS (SELECT p_partkey, w, h, <unnest(<series(0;greatest(<div(h - 1024;640)>, 0))>)> AS i FROM size),
ys AS (SELECT p_partkey, w, h, i * 640 AS y FROM yi UNION ALL SELECT p_partkey, w, h, h - 1024 AS y FROM size WHERE h > 1024 AND (h - 1024) % 640 <> 0),
xi AS (SELECT p_partkey, w, h, y, <unnest(<series(0;<div(w - 1;875)>)>)> AS i FROM ys), xy AS (SELECT p_partkey, w, h, y, i * 875 AS x FROM xi),
grid AS (SELECT p_partkey, w, h, <int(x)> AS x, <int(y)> AS y, <int(least(875, w - x))> AS cw, <int(least(1024, h - y))> AS ch FROM xy WHERE least(875, w - x) >= 56)"""
shared("chunk_grid", f"WITH {GRID} SELECT p_partkey, <long(row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1)> AS chunk_index, x, y, cw AS width, ch AS height FROM grid")
shared("box_pct", f"WITH {GRID} SELECT p_partkey, x, y, round(1e2 * x / w, 6) AS \"left\", round(1e2 * y / h, 6) AS top, round(1e2 * cw / w, 6) AS width, round(1e2 * ch / h, 6) AS height FROM grid WHERE w > 0 AND h > 0".replace('"left"', "left_pct"))
shared("crop_window", """WITH b AS (SELECT l_orderkey, min(l_quantity) AS l, min(l_linenumber * 9e0) AS t, max(l_quantity + 2) AS r, max(l_linenumber * 9e0 + 1) AS bt FROM lineitem GROUP BY l_orderkey),
p AS (SELECT l_orderkey, greatest(0e0, l - 4) AS l, greatest(0e0, t - 4) AS t, least(1e2, r + 4) AS r, least(1e2, bt + 4) AS bt FROM b),
g AS (SELECT l_orderkey, CASE WHEN r - l < 20 THEN greatest(0e0, (l + r) / 2 - 12) ELSE l END AS l, CASE WHEN r - l < 20 THEN least(1e2, (l + r) / 2 + 12) ELSE r END AS r, CASE WHEN bt - t < 8 THEN greatest(0e0, (t + bt) / 2 - 5) ELSE t END AS t, CASE WHEN bt - t < 8 THEN least(1e2, (t + bt) / 2 + 5) ELSE bt END AS bt FROM p)
SELECT l_orderkey, l AS left_pct, t AS top_pct, r - l AS width, bt - t AS height FROM g""")
# Tokens of an image by two providers' rules, and the size that lands on the cheapest grid of 768-pixel tiles.
shared("image_tokens", f"""WITH {SIZE}, s AS (SELECT p_partkey, w, h, <div(w + 767;768)> * <div(h + 767;768)> AS tiles, least(1e0, 1568e0 / greatest(w, h)) AS f FROM size),
c AS (SELECT p_partkey, w, h, tiles, <unnest(<series(1;<div(w + 767;768)>)>)> AS gc FROM s), r AS (SELECT p_partkey, w, h, tiles, gc, <unnest(<series(1;<div(h + 767;768)>)>)> AS gr FROM c),
k AS (SELECT p_partkey, w, h, tiles, gc, gr, least(least(gc * 768e0 / w, gr * 768e0 / h), 1e0) AS sc FROM r),
n AS (SELECT p_partkey, sc, <long(greatest(1, floor(w * sc + 1e-9)))> AS nw, <long(greatest(1, floor(h * sc + 1e-9)))> AS nh FROM k WHERE sc >= 0.85e0),
o AS (SELECT p_partkey, nw, nh, row_number() OVER (PARTITION BY p_partkey ORDER BY <div(nw + 767;768)> * <div(nh + 767;768)>, sc DESC) AS pick FROM n)
SELECT s.p_partkey, <long(tiles * 258)> AS tile_tokens, <long(round(w * f * h * f / 750))> AS area_tokens, nw AS target_width, nh AS target_height FROM s JOIN o ON s.p_partkey = o.p_partkey AND pick = 1""")
shared("chunk_text_clip", """WITH wd AS (SELECT l_orderkey, l_linenumber, l_quantity * 16 AS x, l_linenumber * 150 AS y, l_returnflag || CAST(l_linenumber AS VARCHAR(9)) AS word FROM lineitem),
box AS (SELECT 0 AS chunk, 0 AS x, 0 AS y UNION ALL SELECT 1 AS chunk, 400 AS x, 0 AS y UNION ALL SELECT 2 AS chunk, 0 AS x, 400 AS y),
i AS (SELECT l_orderkey, chunk, l_linenumber, word FROM wd JOIN box ON wd.x >= box.x AND wd.x < box.x + 500 AND wd.y >= box.y AND wd.y < box.y + 700)
SELECT l_orderkey, chunk, <agg(word;' ';l_linenumber)> AS text FROM i GROUP BY l_orderkey, chunk""")


# Words of a page: those of a turn, eight a line, boxes by length.
def page_words(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", cite_tokens(F.col("text")).alias("t"))
    word = lambda t, i: F.struct((i % 8 * 12.0).alias("x0"), (F.floor(i / 8) * 2.0).alias("y0"), (i % 8 * 12.0 + F.char_length(t)).alias("x1"), (F.floor(i / 8) * 2.0 + 1.5).alias("y1"), t.alias("token"), F.floor(i / 8).cast("int").alias("line"))
    return c.withColumn("words", F.transform("t", word))


@query("word_boxes", "SELECT id, i - 1 AS ord, token, CAST((i - 1) // 8 AS INT) AS line, ((i - 1) % 8) * 12e0 AS x0, ((i - 1) % 8) * 12e0 + length(token) AS x1 FROM (SELECT conv_id * 100 + turn AS id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(translate(text, '" + T.FOLD_FROM + "', '" + T.FOLD_TO + "')), '[0-9a-z]+') AS t FROM conversations))")
def word_boxes(spark, sf_dir):
    w = page_words(spark, sf_dir).select("id", F.posexplode("words").alias("ord", "w"))
    return w.select("id", F.col("ord").cast("long").alias("ord"), "w.token", "w.line", "w.x0", "w.x1")


def quoted(spark, sf_dir):
    """Each page with a quote of its own words, one of them left out."""
    p = page_words(spark, sf_dir)
    return p.select("id", "words", F.concat(F.slice("t", 3, 5), F.slice("t", 9, 3)).alias("quote"))


def folded_tokens(text: str) -> str:
    """DuckDB: the words of a text, folded, as quotes are compared."""
    return f"regexp_extract_all(lower(translate({text}, '{T.FOLD_FROM}', '{T.FOLD_TO}')), '[0-9a-z]+')"


def walked(rows: str) -> str:
    """DuckDB, recursive: rn (id, ord, run_start, run_end, matched) of a quote's tokens qt among a page's t, for rows (id, ord, t, qt)."""
    lengths = "list_transform(qt, lambda x: length(x))"
    return f"""src AS ({rows}), pv AS (SELECT id, ord, t, qt, CASE WHEN list_contains(t, qt[1]) THEN 1 ELSE list_position({lengths}, list_max({lengths})) END AS k FROM src WHERE len(t) > 0 AND len(qt) > 0),
st AS (SELECT id, ord, unnest(list_filter(range(k, len(t) + 1), lambda i: t[i] = qt[k])) - k AS start FROM pv),
wk AS (SELECT id, ord, start, start AS pos, 0 AS done, 2 + len(qt) // 4 AS spare, 0 AS step FROM st JOIN pv USING (id, ord) UNION ALL
SELECT id, ord, start, coalesce(e, pos + 1), done + CASE WHEN e IS NULL THEN 0 ELSE 1 END, spare - CASE WHEN e IS NULL THEN 1 ELSE 0 END, step + 1 FROM
(SELECT wk.*, list_filter(range(pos + 1, least(len(t), pos + length(qt[done + 1])) + 1), lambda x: array_to_string(list_slice(t, pos + 1, x), '') = qt[done + 1])[1] AS e FROM wk JOIN pv USING (id, ord) WHERE done < len(qt) AND pos < len(t) AND spare >= 0)),
ed AS (SELECT id, ord, start, arg_max(pos, step) AS pos, max(done) AS done FROM wk GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY id, ord ORDER BY done DESC, start) AS pick FROM ed WHERE done > 0),
rn AS (SELECT id, ord, t, qt, coalesce(start, 0) AS run_start, coalesce(pos, 0) AS run_end, coalesce(done, 0) AS matched FROM src LEFT JOIN (SELECT * FROM pk WHERE pick = 1) USING (id, ord))"""


#: DuckDB: the words of the lines that a found run spans, and the rectangle around each line's.
LINES = """fd AS (SELECT *, round(matched * 1e0 / len(qt), 2) AS coverage FROM rn WHERE matched >= 2 AND matched >= 0.55e0 * len(qt)),
inn AS (SELECT id, ord, qt, coverage, unnest(range(run_start, run_end)) AS i, unnest(list_slice(t, run_start + 1, run_end)) AS w FROM fd),
ln AS (SELECT id, ord, i // 8 AS line, coverage, min(i % 8 * 12e0) AS x0, max(i % 8 * 12e0 + length(w)) AS x1, min(i // 8 * 2e0) AS y0 FROM inn WHERE len(list_filter(qt, lambda x: contains(x, w) OR contains(w, x))) > 0 GROUP BY ALL)"""
_QUOTED = f"SELECT id, 0 AS ord, t, list_concat(list_slice(t, 3, 7), list_slice(t, 9, 11)) AS qt FROM (SELECT conv_id * 100 + turn AS id, {folded_tokens('text')} AS t FROM conversations)"


@query("quote_match", f"WITH RECURSIVE {walked(_QUOTED)} SELECT id, CAST(run_start AS BIGINT) AS start, CAST(run_end AS BIGINT) AS end, CAST(matched AS BIGINT) AS matched, matched >= 2 AND matched >= 0.55e0 * len(qt) AS found FROM rn")
def quote_match(spark, sf_dir):
    return C.match_quotes(quoted(spark, sf_dir))


@query("quote_rects", f"WITH RECURSIVE {walked(_QUOTED)}, {LINES} SELECT id, CAST(line AS INT) AS line, x0 AS left, y0 AS top, x1 - x0 AS width, 1.5e0 AS height, coverage FROM ln")
def quote_rects(spark, sf_dir):
    return C.quote_rects(quoted(spark, sf_dir))


def figured(rows: str, line: str) -> str:
    """DuckDB: fg (id, value, place, spans) of the figures of `said` that stand among a page's tokens t, for rows (id, t, said); `line`
    is that of a place i."""
    raw = r"regexp_extract_all(said, '\d[\d\s.,\x{00A0}\x{202F}]{1,12}\d|\d{2,}')"
    return f"""fr AS ({rows}), fv AS (SELECT id, t, list_filter(list_transform({raw}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 3 AND 6) AS vs FROM fr),
fu AS (SELECT id, t, unnest(vs) AS value, generate_subscripts(vs, 1) AS i FROM fv), fo AS (SELECT id, any_value(t) AS t, value, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS place FROM fu GROUP BY id, value),
fs AS (SELECT id, value, place, t, list_filter(range(len(t)), lambda i: regexp_full_match(t[i + 1], '[0-9]+') AND starts_with(value, t[i + 1])) AS begins FROM fo WHERE place <= 8),
fg AS (SELECT id, value, place, t, list_filter(list_transform(begins, lambda a: {{'a': a, 'b': list_filter(range(a + 1, least(len(t), a + length(value)) + 1), lambda x: array_to_string(list_slice(t, a + 1, x), '') = value)[1]}}), lambda s: s.b IS NOT NULL AND {line.format("s.a")} = {line.format("(s.b - 1)")}) AS spans FROM fs)"""


_SAID = "text || ' 3 956 zł 2500 x 2100, 2500 ' || CAST(conv_id * 101 AS VARCHAR)"


@query("number_pins", f"""WITH {figured(f"SELECT conv_id * 100 + turn AS id, {folded_tokens(_SAID)} AS t, {_SAID} AS said FROM conversations", "0 * {}")}
SELECT id, value, CAST(len(spans) AS BIGINT) AS count, CASE WHEN len(spans) = 1 THEN spans[1].a % 8 * 12e0 END AS left, CASE WHEN len(spans) = 1 THEN spans[1].a // 8 * 2e0 END AS top FROM fg WHERE len(spans) > 0""")
def number_pins(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" 3 956 zł 2500 x 2100, 2500 "), (F.col("conv_id") * 101).cast("string")).alias("text"))
    id_ = (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    word = lambda t, i: F.struct((i % 8 * 12.0).alias("x0"), (F.floor(i / 8) * 2.0).alias("y0"), (i % 8 * 12.0 + F.char_length(t)).alias("x1"), (F.floor(i / 8) * 2.0 + 1.5).alias("y1"), t.alias("token"), F.lit(0).alias("line"))
    return C.pin_figures(c.select(id_, "text", F.transform(cite_tokens(F.col("text")), word).alias("words")))




# Answers with four citations: of the first attached page without its article, of it a quote that it doesn't hold, one of an article
# that has no such page, and of the second attached page.
_PAGE = "text || ' 2500 ' || CAST(1000 + doc_id AS VARCHAR) || ' 2500'"
_ATT = f"""nc AS (SELECT max(conv_id) + 1 AS n FROM conversations), pg AS (SELECT doc_id, doc_id % 3 AS article, doc_id % 10 AS page, {folded_tokens(_PAGE)} AS t FROM documents),
an AS (SELECT conv_id * 100 + turn AS id, conv_id, text FROM conversations WHERE role <> 'user'),
att AS (SELECT id, an.text, pg.*, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS rank FROM an, nc, pg WHERE pg.doc_id % nc.n = an.conv_id),
ans AS (SELECT id, any_value(text) || ' 2500 zł, ' || string_agg(CAST(1000 + doc_id AS VARCHAR), ' / ' ORDER BY rank) AS said FROM att GROUP BY id),
ct AS (SELECT id, 1 AS ord, page, NULL AS article, list_concat(list_slice(t, 3, 7), list_slice(t, 9, 11)) AS qt FROM att WHERE rank = 1 UNION ALL SELECT id, 2, page, article, ['nie', 'ma', 'takiego'] FROM att WHERE rank = 1
UNION ALL SELECT id, 3, page, article + 3, ['x'] FROM att WHERE rank = 1 UNION ALL SELECT id, 4, page, article, list_slice(t, 5, 8) FROM att WHERE rank = 2),
met AS (SELECT ct.id, ct.ord, doc_id, att.article, att.page, t, qt, row_number() OVER (PARTITION BY ct.id, ct.ord ORDER BY rank) AS pick FROM ct JOIN att ON att.id = ct.id AND att.page = ct.page AND (ct.article IS NULL OR ct.article = att.article)),
one AS (SELECT id, ord, doc_id, t, qt, ord = min(ord) OVER (PARTITION BY id, article, page) AS first FROM met WHERE pick = 1)"""
_FIGURED = figured("SELECT id * 10 + ord AS id, t, said FROM one JOIN ans USING (id) WHERE first", "({} // 8)")


@query("citation_report", f"""WITH RECURSIVE {_ATT}, {walked("SELECT id, ord, t, qt FROM one")}, {LINES}, {_FIGURED},
rc AS (SELECT id, ord, count(*) AS n, sum(x0) AS lefts, sum(y0) AS tops, sum(x1 - x0) AS widths FROM ln GROUP BY ALL), nm AS (SELECT id, string_agg(value || ':' || CAST(spans[1].a AS VARCHAR), ' ' ORDER BY place) FILTER (len(spans) = 1) AS numbers, string_agg(value || ' x ' || CAST(len(spans) AS VARCHAR), ' ' ORDER BY place) FILTER (len(spans) > 1) AS repeated FROM fg WHERE len(spans) > 0 GROUP BY id)
SELECT one.id, one.ord, one.doc_id AS document, fd.id IS NOT NULL AS verified, coalesce(fd.coverage, 0e0) AS coverage, CAST(coalesce(rc.n, 0) AS INT) AS n_rects, coalesce(lefts, 0e0) AS lefts, coalesce(tops, 0e0) AS tops, coalesce(widths, 0e0) AS widths, coalesce(numbers, '') AS numbers, coalesce(repeated, '') AS repeated
FROM one LEFT JOIN fd USING (id, ord) LEFT JOIN rc USING (id, ord) LEFT JOIN nm ON nm.id = one.id * 10 + one.ord""")
def citation_report(spark, sf_dir):
    """Citations resolved: quotes to rectangles, with those not found kept, and figures at each page's first citation."""
    c = read(spark, sf_dir, "conversations")
    n = c.agg(F.max("conv_id") + 1).first()[0] or 1
    docs = read(spark, sf_dir, "documents")
    said = F.concat("text", F.lit(" 2500 "), (F.col("doc_id") + 1000).cast("string"), F.lit(" 2500"))
    pages = docs.select(F.col("doc_id").alias("document"), (F.col("doc_id") % 3).alias("article"), (F.col("doc_id") % 10).alias("page"), cite_tokens(said).alias("t"), (F.col("doc_id") % n).alias("conv_id"))
    an = c.where("role <> 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "text")
    attached = an.join(pages.drop("t"), "conv_id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("document"))).select("id", "text", "article", "page", "rank", "document")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: (x["document"] + 1000).cast("string")), " / ")
    answers = attached.groupBy("id").agg(F.concat(F.first("text"), F.lit(" 2500 zł, "), listed).alias("answer"))
    two = attached.where("rank <= 2").join(pages.select("document", "t"), "document")
    cite = lambda rank, ord_, article, tokens: F.when(F.col("rank") == rank, F.struct(F.lit(ord_).alias("ord"), F.col("page").alias("page"), article.cast("long").alias("article"), tokens.alias("tokens")))
    words = lambda *w: F.array(*map(F.lit, w))
    own = F.col("article")
    four = F.array_compact(F.array(
        cite(1, 1, F.lit(None), F.concat(F.slice("t", 3, 5), F.slice("t", 9, 3))), cite(1, 2, own, words("nie", "ma", "takiego")), cite(1, 3, own + 3, words("x")), cite(2, 4, own, F.slice("t", 5, 4)),
    ))
    cites = two.select("id", F.explode(four).alias("c")).select("id", "c.*").withColumn("quote", F.array_join("tokens", " "))
    word = lambda t, i: F.struct((i % 8 * 12.0).alias("x0"), (F.floor(i / 8) * 2.0).alias("y0"), (i % 8 * 12.0 + F.char_length(t)).alias("x1"), (F.floor(i / 8) * 2.0 + 1.5).alias("y1"), t.alias("token"), F.floor(i / 8).cast("int").alias("line"))
    got = C.resolve(cites, attached.drop("text"), answers, pages.select("document", F.transform("t", word).alias("words")))
    total = lambda f: F.aggregate("rects", F.lit(0.0), lambda s, r: s + r["box"][f])
    at = lambda x: F.concat(x["value"], F.lit(":"), (x["box"]["left"] / 12 + x["box"]["top"] * 4).cast("int").cast("string"))
    return got.select(
        "id", "ord", "document", "verified", "coverage", F.size("rects").alias("n_rects"), total("left").alias("lefts"), total("top").alias("tops"), total("width").alias("widths"),
        F.array_join(F.transform("numbers", at), " ").alias("numbers"), F.array_join(F.transform("repeated", lambda x: F.concat(x["value"], F.lit(" x "), x["count"].cast("string"))), " ").alias("repeated"),
    )
