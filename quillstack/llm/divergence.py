"""Source divergence audit: how far the sources of a language are from each other, and in which terms.

Each language keeps the terms that `LEAST_DOCS` of its documents have.  Every group (language, source) gives
each kept term a smoothed share p of `SCALE`, all in whole numbers; two shares diverge by (p - q)^2 / (p + q).

Pairs are sparse: a pair's sum over all kept terms is that of two groups without any term, times the number of terms,
corrected for the terms that one has (by counts: terms of equal count are corrected at once) and for those that
both have.  So nothing is made for terms that neither has.

Ranks are found by radix selection: a histogram over the value's upper bits gives each group's bucket that holds
its kth value, a histogram over the next bits of that bucket's rows the next, and so on to the value itself.  Rows over it
are in; of rows at it so many as there are places left, the first by UTF-8 bytes, found by histograms over the
item's bytes in the same way until what is left of a group is `FEW`, which are then sorted.  No group is sorted whole.

Defined results: null text, language and source are read as ''; repeated rows and ids count as documents of their own;
a group without terms, and a language without kept terms (all its pairs are 0), appear; a language's only source
has no pair; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, if_few, ship, stored, table

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bits that values have at most (a value is no more than the larger share), and those of a round's histogram.
VALUE_BITS, DIGIT_BITS = 30, 10
#: Bytes of a round's histogram over items, and tied items of a group that are sorted.
ITEM_BYTES, FEW = 2, 4096
#: Terms that a task counts before it hands them on.
COUNTED = 400_000
#: Bytes of terms are letters (A-Z lower-cased) and all from 0x80 on; any other is a blank.
_TERMS = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs), in parts: a group's term may have several rows, to be summed."""
    ship(docs.sparkSession)

    def work(batches):
        import collections

        import pyarrow as pa

        def batch(groups):
            rows = [(l, s, t, n, groups[l, s][1][t]) for (l, s), (of, _) in groups.items() for t, n in of.items()]
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=["lang", "source", "term", "n", "docs"])

        fresh_ = lambda: collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
        groups, size = fresh_(), 0
        for b in batches:
            for l, s, t in zip(*(c.to_pylist() for c in b.columns)):
                terms = t.translate(_TERMS).split()
                if not terms:
                    continue
                n, in_docs = groups[l, s]
                size -= len(n)
                n.update(terms)
                in_docs.update(set(terms))
                size += len(n)
                if size > COUNTED:
                    yield batch(groups)
                    groups, size = fresh_(), 0
        if size:
            yield batch(groups)

    some = docs.select(_said(lang).alias("lang"), _said(source).alias("source"), _said(text).cast("binary").alias("t"))
    return some.mapInArrow(work, "lang string, source string, term binary, n long, docs long")


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_cells(parts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the kept terms' occurrences in each group that has them and in the language;
    first marks one row of each term."""
    # One exchange by (lang, term) serves the sums of a group and those of its language; tasks have summed their own before.
    of = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    of = of.withColumns({"all_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": F.col("source") == F.min("source").over(w)})
    return of.where(F.col("all_docs") >= least_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / total), exact for counts up to 10 ** 19."""
    return _div(F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): the square fits a long, as shares are SCALE + 1 at most."""
    return _div((p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, cells: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, terms, total, lang_total, base): every occurring group, the number of kept terms of its language, what its
    and its language's shares are parts of, and the share of a term that it lacks (null without kept terms)."""
    all_ = docs.select(_said(lang).alias("lang"), _said(source).alias("source")).distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    got = all_.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "lang_n", "terms"])
    twice = 2 * F.col("terms")
    got = got.select("lang", "source", "terms", (F.col("n") + twice).alias("total"), (F.col("lang_n") + twice).alias("lang_total"))
    return got.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"))))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): of each group and each other source of its language, the sum of `apart` over all kept terms."""
    one = groups.select("lang", "source", "terms", "base")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    fewer = F.col("source") < F.col("item")
    neither = apart(F.col("base"), F.col("item_base"))
    start = one.join(other, "lang").where(fewer).select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * neither).otherwise(0).alias("value"))
    # Terms of equal count have one share, so they are corrected together, against each other source's base.
    counts = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("of"))
    counts = counts.join(if_few(one.drop("terms")), ["lang", "source"])
    against = counts.join(other, "lang").where("source <> item")
    alone = against.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("of") * (apart(F.col("p"), F.col("item_base")) - neither)).alias("value"))
    # Terms that both have: what was corrected twice is set right.
    a = cells.join(if_few(one.drop("terms")), ["lang", "source"]).select("lang", "term", "source", "p", "base")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("item_base"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "base", "item_base"))
    both = a.join(b, ["lang", "term"]).where(fewer).select("lang", "source", "item", (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value"))
    half = start.unionByName(alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    half = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    each = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", each.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def _places(hist: DataFrame, by: list[str], slot: Column, left: str = "left") -> DataFrame:
    """Of a histogram (by, slot, rows, left) each group's slot, in the order of `slot`, that holds the last of its `left` places,
    with the places left for it and its rows."""
    before = F.sum("rows").over(Window.partitionBy(*by).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1))
    hist = hist.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.col(left))
    last = F.max_by(F.struct("slot", "rows", (F.col(left) - F.col("before")).alias("left")), "before").alias("x")
    return hist.groupBy(*by).agg(last).select(*by, F.col("x.slot").alias("slot"), F.col("x.rows").alias("rows"), F.col("x.left").alias("left"))


def top_ranks(rows: DataFrame, by: list[str], k: int = TOP, bits: int = VALUE_BITS, digit: int = DIGIT_BITS, few: int = FEW) -> DataFrame:
    """(by, item, value, rank): of each group of `rows` (by, item, value; items of a group differ) the k rows of largest
    value, the first items in byte order of equal ones."""
    rows = rows.withColumn("bytes", F.encode("item", "UTF-8"))
    bound = None
    for shift in range((bits - 1) // digit * digit, -1, -digit):
        slot = F.shiftright("value", shift)
        some = rows.withColumn("left", F.lit(k)) if bound is None else rows.join(if_few(bound), by).where(F.shiftright("value", shift + digit) == F.col("slot")).drop("slot")
        hist = some.groupBy(*by, slot.alias("slot")).agg(F.count("*").alias("rows"), F.first("left").alias("left"))
        bound = stored(_places(hist, by, F.col("slot").desc()), "top-values")
    at = rows.join(if_few(bound.withColumnsRenamed({"slot": "least", "rows": "tied"})), by)
    sure = at.where((F.col("value") > F.col("least")) | (F.col("value") == F.col("least")) & (F.col("tied") <= F.col("left")))
    out = [sure.select(*by, "item", "value")]
    ties = at.where((F.col("value") == F.col("least")) & (F.col("tied") > F.col("left"))).select(*by, "item", "value", "bytes")
    bound, begin = stored(bound.where("rows > left").select(*by, "rows", "left", F.lit(b"").alias("prefix")), "top-ties"), 0
    while bound.limit(1).count():
        some = ties.join(if_few(bound), by).where(F.col("bytes").substr(1, begin) == F.col("prefix"))
        # Few rows left of a group, or as many as places, need no more histograms.
        ended = (F.col("rows") <= few) | (F.col("rows") <= F.col("left"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("bytes"))
        out.append(some.where(ended).withColumn("rank", rank).where(F.col("rank") <= F.col("left")).select(*by, "item", "value"))
        open_ = some.where(~ended)
        hist = open_.groupBy(*by, F.col("bytes").substr(1, begin + ITEM_BYTES).alias("slot")).agg(F.count("*").alias("rows"), F.first("left").alias("left"))
        next_ = _places(hist, by, F.col("slot").asc()).withColumnRenamed("slot", "prefix")
        bound, last = stored(next_, "top-ties"), bound
        # What comes before the bucket is in.
        before = open_.drop("rows", "left", "prefix").join(if_few(bound), by).where(F.col("bytes").substr(1, begin + ITEM_BYTES) < F.col("prefix"))
        out.append(before.select(*by, "item", "value"))
        begin += ITEM_BYTES
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    order = Window.partitionBy(*by).orderBy(F.desc("value"), F.encode("item", "UTF-8"))
    return all_.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair ranks all other sources of the language, part term the
    k terms that the group has most above its language."""
    cells = stored(kept_cells(term_counts(docs, lang, source, text), least_docs), "divergence-cells")
    groups = stored(groups_of(docs, cells, lang, source), "divergence-groups")
    of = cells.join(if_few(groups), ["lang", "source"])
    of = stored(of.select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q")), "divergence-shares")
    pairs = pair_values(of, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.encode("item", "UTF-8"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))  # a group has as many rows as its language has sources
    terms = top_ranks(of.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), ["lang", "source"], k)
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int"))
    return told(pairs, "pair").unionByName(told(terms, "term"))


def op11_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL),
share AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + (CAST({SCALE} AS HUGEINT) * (coalesce(o.n, 0) + 2)) // (coalesce(total.n, 0) + 2 * v.v) AS p,
    1 + (CAST({SCALE} AS HUGEINT) * (k.lang_n + 2)) // (v.n + 2 * v.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN own o USING (lang, source, term) LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM share WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= {TOP}
"""
