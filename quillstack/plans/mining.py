"""Text and mining queries, and rules over candidate questions.

Pages are documents, one article for each source.  Headings are mined from the text of `pages` and
`documents`; conversations are the questions asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.contain import containing, overlaps
from ..operators.ordinal import with_ordinal
from .registry import query, shared, spark_sql, told, views
from .retrieval import read

_STRIP = "regexp_replace(regexp_replace(text, '" + T.FILLER + "', ''), '^\\s+|\\s+$', '', 'g')"
_CUT = "CASE " + " ".join(f"WHEN starts_with(lower(s), '{p} ') THEN trim(substr(s, {len(p) + 1}), ' ?.,:')" for p in T.PREFIXES) + " ELSE s END"
PHRASE = f"""np AS (SELECT conv_id, turn, text, CASE WHEN c <> '' AND lower(c) <> lower(trim(text, ' ?.,:')) THEN c ELSE '' END AS phrase
FROM (SELECT *, trim({_CUT}, ' ?.,:') AS c FROM (SELECT conv_id, turn, text, {_STRIP} AS s FROM ask)))"""
# Questions: the users' turns, with an opening put before some, so that every rule is met.
ASK = """ask AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Ile kosztuje ' WHEN 1 THEN 'show me ' WHEN 2 THEN 'Informacje na temat ' ELSE '' END || text AS text FROM conversations WHERE role = 'user')"""


def asked(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    m = F.col("conv_id") % 4
    opening = F.when(m == 0, "Ile kosztuje ").when(m == 1, "show me ").when(m == 2, "Informacje na temat ").otherwise("")
    return c.select("conv_id", "turn", F.concat(opening, "text").alias("text"))


@query("noun_phrase", f"WITH {ASK}, {PHRASE} SELECT conv_id, turn, phrase FROM np")
def noun_phrase(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", T.noun_phrase(F.col("text")).alias("phrase"))


@query("query_variants", rf"WITH {ASK}, {PHRASE} SELECT conv_id, turn, 0 AS variant, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM np UNION ALL SELECT conv_id, turn, 1, phrase FROM np WHERE length(phrase) >= 3")
def query_variants(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.query_variants(F.col("text"))).alias("variant", "q"))


# Revisions: a date line, made from the document's number, before every third text.
_REV = """d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '0' || CAST(1 + doc_id % 9 AS VARCHAR(9)) || '.0' || CAST(1 + doc_id % 8 AS VARCHAR(9)) || '.2024 ' WHEN 1 THEN '01.01.2020 x CBG/PL-PLN/10.04.2025 ' ELSE '' END || text AS text FROM documents)"""


def dated(text):
    day, month = (F.lpad((1 + F.col("doc_id") % n).cast("string"), 2, "0") for n in (9, 8))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(day, F.lit("."), month, F.lit(".2024 "))).when(F.col("doc_id") % 3 == 1, "01.01.2020 x CBG/PL-PLN/10.04.2025 ").otherwise("")
    return F.concat(head, text)


@query("revision_extract", f"""WITH {_REV}, r AS (SELECT doc_id, regexp_extract(text, 'CBG/PL-PLN/([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})', 1) AS a, regexp_extract(substr(text, 1, 400), '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') AS b FROM d)
SELECT doc_id, CASE WHEN a <> '' THEN a[7:10] || '-' || a[4:5] || '-' || a[1:2] WHEN b <> '' THEN b[7:10] || '-' || b[4:5] || '-' || b[1:2] END AS revision FROM r""")
def revision_extract(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.revision(dated("text")).alias("revision"))


@query("text_flat", "SELECT doc_id, lower(trim(regexp_replace(replace(replace(text, chr(173), ''), chr(160), ' '), '\\s+', ' ', 'g'))) AS flat FROM documents")
def text_flat(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.flat(F.col("text")).alias("flat"))


# Headings (their stop words are fixed values): short lines, mostly of capitals.  Titles of the documents' first words, in capitals, are among the lines.
HEAD = r"""ln AS (SELECT doc_id, source, <unnest(<part(line;'~')>)> AS raw FROM (SELECT doc_id, source, upper(replace(substr(text, 1, 12 + CAST(doc_id % 30 AS INT)), 'ß', 'ss')) || '~' || replace(replace(text, '~', ' '), chr(10), '~') || '~DATA SHEET~SECTION ' || CAST(doc_id % 7 AS VARCHAR(9)) || ' PART A' AS line FROM documents) t),
st AS (SELECT doc_id, source, <trim(<trim(<swap(raw;'[ \t\r\n\f\v]+';' ')>;' ')>;' -–—:|')> AS s FROM ln),
hd AS (SELECT doc_id, source, s, <part(s;' ')> AS w, length(<swap(s;'[^\p{{L}}]';'')>) AS letters, length(<swap(s;'[^\p{{Lu}}]';'')>) AS caps FROM st),
head AS (SELECT DISTINCT doc_id, source, s FROM hd WHERE length(s) BETWEEN 3 AND 60 AND <len(w)> BETWEEN 1 AND 6 AND NOT <like(s;'[.,\x3B:]$')>
         AND lower(<at(w;-1)>) NOT IN ('i','oraz','lub','w','we','z','ze','na','do','od','za','o','u','dla','przy','po','pod','nad','bez','przez','gdzie','które','który','która','jest','są','aby','że')
         AND NOT <like(s;'^[^\p{{L}}]*$|^[^ ]{{1,3}} *[–-] *[0-9]')> AND letters >= 3 AND caps >= letters * 0.85e0)"""
HEAD = HEAD.replace("{{", "{").replace("}}", "}")
SUBJ = HEAD + r""", dp AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
fr AS (SELECT head.*, count(*) OVER (PARTITION BY head.source, s) AS freq, pages FROM head JOIN dp ON head.source = dp.source),
ok AS (SELECT *, lower(<swap(s;'[^0-9a-zA-ZąćęłńóśźżĄĆĘŁŃÓŚŹŻ]+';'')>) AS k FROM fr WHERE NOT (pages >= 4 AND freq * 1e0 / pages > 0.3e0)),
subj AS (SELECT doc_id, source, <trim(s;'()[]{}')> AS subject FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS pick FROM ok WHERE k <> '') x WHERE pick = 1)"""
shared("heading_mine", f"WITH {HEAD} SELECT doc_id, s AS heading FROM head")
shared("subject_mine", f"WITH {SUBJ} SELECT doc_id, subject FROM subj")
# Forms of questions.
FORMS = """forms AS (SELECT 'a' AS form, 'Co to jest "{s}"?' AS t UNION ALL SELECT 'b' AS form, '{s} — jakie są parametry techniczne?' AS t UNION ALL SELECT 'c' AS form, '{s} — jakie warianty są dostępne?' AS t UNION ALL SELECT 'd' AS form, 'Do czego służy "{s}"?' AS t)"""
QUES = f"{SUBJ}, {FORMS}, ques AS (SELECT doc_id, subject, form, replace(t, '{{s}}', subject) AS q FROM subj CROSS JOIN forms)"
shared("question_forms", f"WITH {QUES} SELECT doc_id, form, q FROM ques")
shared("subject_recover", f"""WITH {QUES} SELECT doc_id, form, CASE WHEN <like(q;'"[^"]+"')> THEN regexp_extract(q, '"([^"]+)"', 1) ELSE <at(<part(q;' — ')>;1)> END AS subject FROM ques""")
# '0:0-5,1:0-4': zero-based pages of articles, one added; junk is left out, the last of duplicates stays.
shared("pages_1based", """WITH r AS (SELECT conv_id, CAST(min(turn) AS VARCHAR(9)) || ':' || CAST(conv_id % 7 AS VARCHAR(9)) || '-' || CAST(count(*) AS VARCHAR(9)) || ',x:1,' || CAST(conv_id % 3 AS VARCHAR(9)) || ':' || CAST(count(*) + 2 AS VARCHAR(9)) AS spec FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, spec, <unnest(<series(1;<len(<part(spec;',')>)>)>)> AS i FROM r),
p AS (SELECT conv_id, i, <at(<part(spec;',')>;<int(i)>)> AS s FROM i),
v AS (SELECT conv_id, i, CAST(regexp_extract(s, '^([0-9]+):', 1) AS INT) AS a, CAST(regexp_extract(s, ':([0-9]+)', 1) AS INT) AS lo, try_cast(regexp_extract(s, '-([0-9]+)$', 1) AS INT) AS hi FROM p WHERE <like(s;'^[0-9]+:[0-9]+(-[0-9]+)?$')>)
SELECT conv_id, a AS article, lo + 1 AS first_page, coalesce(hi, lo) + 1 AS last_page FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY i DESC) AS pick FROM v) x WHERE pick = 1""".replace("CAST(regexp_extract(s, '^", "try_cast(regexp_extract(s, '^").replace("CAST(regexp_extract(s, ':(", "try_cast(regexp_extract(s, ':("))
ANSWERS = """ans AS (SELECT conv_id, turn, text || CASE conv_id % 5 WHEN 0 THEN ' UniPro SNP 3 956 zł' WHEN 1 THEN ' brak informacji' WHEN 2 THEN ' PRIME 2500 x 2100, 2500' ELSE '' END AS text FROM conversations WHERE role <> 'user')"""
# Product families.
FAMILIES = ["UniPro SNP", "UniPro", "PRIME", "RenoSystem", "DoorPro", "roletow", "uchyln", "Novum", "Progress", "Komfort", "Select", "City", "Connect", "MakroPro"]
ANY_FAMILY = "max(CASE WHEN " + " OR ".join(f"<has(lower(text);'{f.lower()}')>" for f in FAMILIES) + " THEN 1 ELSE 0 END)"
shared("answer_flags", f"""WITH {ANSWERS} SELECT conv_id, turn, {' + '.join(f"CASE WHEN <has(lower(text);'{f.lower()}')> THEN 1 ELSE 0 END" for f in FAMILIES)} AS n_families,
<like(lower(text);'nie ma|nie zawiera|nie znalaz|brak informacji|nie mogę')> AS refused FROM ans""")
NUMBERS = r"<distinct(<only(<each(<alln(text;'[0-9][0-9\s.,]{1,12}[0-9]|[0-9]{2,}')>;<swap(x;'[\s.,]';'')>)>;length(x) BETWEEN 3 AND 6)>)>"
shared("answer_numbers", f"WITH {ANSWERS}, n AS (SELECT conv_id, turn, {NUMBERS} AS v FROM ans) SELECT conv_id, turn, least(<len(v)>, 8) AS n_numbers FROM n")


@query("stride_sample", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT doc_id, i, greatest(1, n // 50) AS step FROM r) SELECT doc_id FROM s WHERE i % step = 0 AND i // step < 50")
def stride_sample(spark, sf_dir, limit=50):
    """Every n-th document, `limit` of them."""
    rows, n = with_ordinal(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    step = max(1, n // limit)
    return rows.where((F.col("ordinal") % step == 0) & (F.col("ordinal") < step * limit)).select("doc_id")


# Scores of the deterministic judge: from the subject's letters.
CAND = f"{SUBJ}, cand AS (SELECT doc_id, source, subject, least(1e0, length(subject) / 2e1) AS well_formed, least(1e0, 0.4e0 + length(replace(subject, ' ', '')) / 4e1) AS specific, CASE WHEN doc_id % 2 = 0 THEN 0.7e0 ELSE 0.5e0 END AS product FROM subj)"
shared("candidate_gate", f"WITH {CAND} SELECT doc_id, subject, CASE WHEN well_formed < 0.6e0 THEN 'malformed' WHEN specific < 0.5e0 THEN 'vague' ELSE 'kept' END AS outcome FROM cand")
ACCEPTED = f"WITH {CAND} SELECT doc_id, subject FROM cand WHERE well_formed >= 0.6e0 AND specific >= 0.5e0 AND product >= 0.6e0"
# Probes.
PROBES = {"price": 'Ile kosztuje "{s}"?', "procedure": 'Jak zamontować "{s}"?'}


@query("probe_questions", f"""WITH acc AS (SELECT *, row_number() OVER (ORDER BY doc_id, subject) AS i FROM ({ACCEPTED})), kinds AS (SELECT 'price' AS kind, '{PROBES["price"]}' AS t UNION ALL SELECT 'procedure', '{PROBES["procedure"]}')
SELECT doc_id, kind, replace(t, '{{s}}', subject) AS q FROM acc, kinds WHERE i % 2 = 1""")
def probe_questions(spark, sf_dir):
    """Two questions about every second accepted subject."""
    said = told(ACCEPTED, "spark")
    views(spark, sf_dir, said)
    rows, _ = with_ordinal(spark.sql(said.replace("\\", "\\\\")), ["doc_id", "subject"])
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, t in PROBES.items()]))
    return rows.where("ordinal % 2 = 0").withColumn("f", forms).select("doc_id", "f.kind", F.replace("f.t", F.lit("{s}"), F.col("subject")).alias("q"))


# Subjects are benchmark items; a document is gold if it holds one.
GROUND = "su AS (SELECT item_id, lower(text) AS s FROM benchmark), lo AS (SELECT doc_id, source, lower(text) AS t FROM documents), hit AS (SELECT item_id, doc_id, source FROM lo JOIN su ON <has(t;s)>), nh AS (SELECT item_id, count(*) AS n_pages, min(doc_id) AS first_page FROM hit GROUP BY item_id)"


def held(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return containing(pages, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("s")))


@query("grounded", f"WITH {GROUND} SELECT su.item_id, coalesce(n_pages, 0) > 0 AS grounded FROM su LEFT JOIN nh ON su.item_id = nh.item_id")
def grounded(spark, sf_dir):
    found = held(spark, sf_dir).select(F.col("item").alias("item_id")).distinct().withColumn("found", F.lit(True))
    return read(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("grounded"))


@query("verified_subset", f"WITH {GROUND} SELECT item_id, first_page AS page FROM nh WHERE n_pages = 1")
def verified_subset(spark, sf_dir):
    """Items that exactly one page holds."""
    one = held(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.min("key").alias("page")).where("n = 1")
    return one.select(F.col("item").alias("item_id"), "page")


OV = f"""ov AS (SELECT item_id, doc_id, source, round(n / m, 9) AS score FROM (SELECT i.item_id, d.doc_id, d.source, count(*) * 1e0 AS n, max(i.m) AS m FROM it i JOIN dt d ON i.term = d.term GROUP BY i.item_id, d.doc_id, d.source) x)"""
TERMS = "it AS (SELECT item_id, term, count(*) OVER (PARTITION BY item_id) AS m FROM (SELECT DISTINCT item_id, <unnest(<part(lower(text);' ')>)> AS term FROM benchmark) a), dt AS (SELECT DISTINCT doc_id, source, term FROM (SELECT doc_id, source, <unnest(<part(lower(text);' ')>)> AS term FROM documents) z WHERE term IN (SELECT term FROM it))"
OVERLAP = f"{TERMS}, {OV}"
GOLD = f"{OVERLAP}, best AS (SELECT item_id, max(score) AS best FROM ov GROUP BY item_id), pick AS (SELECT o.item_id, min(doc_id) AS gold FROM ov o JOIN best b ON o.item_id = b.item_id AND o.score = b.best WHERE best >= 0.66e0 GROUP BY o.item_id), sp AS (SELECT o.item_id, count(*) AS spilled FROM ov o JOIN pick p ON o.item_id = p.item_id JOIN documents d ON d.doc_id = p.gold WHERE o.score >= 0.66e0 AND o.source <> d.source GROUP BY o.item_id)"


def overlap(spark, sf_dir):
    """(item_id, doc_id, source, score): what `ov` says of pairs of 0.3 or more, and of each item's best."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " ", -1))
    docs = read(spark, sf_dir, "documents")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), words("text").alias("words"))
    got = overlaps(docs.select(F.col("doc_id").alias("key"), words("text").alias("words")), items, 0.3)
    rows = got.select(F.col("item").alias("item_id"), F.col("key").alias("doc_id"), F.round(F.col("n") / F.col("of"), 9).alias("score"))
    return rows.join(docs.select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "source", "score")


KEEP = OVERLAP, "ov", overlap
shared("gold_select", f"WITH {GOLD} SELECT b.item_id, gold, round(best, 6) AS best_score, coalesce(spilled, 0) AS spilled FROM best b LEFT JOIN pick ON b.item_id = pick.item_id LEFT JOIN sp ON b.item_id = sp.item_id", keep=KEEP)
shared("oracle_label", f"WITH {GOLD} SELECT item_id, doc_id, round(score, 6) AS score, score >= 0.66e0 AS relevant FROM ov WHERE score >= 0.3e0", keep=KEEP)
_ROWS = """SELECT b.item_id, CASE WHEN gold IS NOT NULL AND n_pages > 0 AND best >= 0.5e0 THEN 'positive' WHEN gold IS NULL AND best <= 0.3e0 THEN 'negative' ELSE 'dropped' END AS kind
FROM best b LEFT JOIN pick ON b.item_id = pick.item_id LEFT JOIN nh ON b.item_id = nh.item_id"""


@query("oracle_rows", f"WITH {GOLD}, {GROUND} {_ROWS}")
def oracle_rows(spark, sf_dir):
    """Rows of a question set: positive with a gold page that holds the item, negative without any, else dropped."""
    overlap(spark, sf_dir).createOrReplaceTempView("item_overlaps")
    held(spark, sf_dir).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_pages")).createOrReplaceTempView("item_pages")
    return spark_sql(spark, sf_dir, f"WITH {GOLD.replace(OVERLAP, 'ov AS (SELECT * FROM item_overlaps)')}, nh AS (SELECT * FROM item_pages) {_ROWS}")
