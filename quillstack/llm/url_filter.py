"""URL filters: host suffixes and path prefixes, joined to rules on short hash prefixes.

Every URL becomes the (host suffix + path prefix) expressions that a rule could have, each is
hashed, the short prefix of the hash is the key of an equi-join with the rules, and the full
digest confirms a match.  Of the rules that fit, the longest (host and path together) wins,
then the longer host, then `block` over `allow`.

Only expressions whose shape (labels in the host, characters in the path) some rule has are
made, so a very long URL makes no more than a short one.  Built of DataFrame functions only.

Defined results: a null URL or one without ``://`` has host and path ``''`` and the default
verdict; an empty table gives an empty result; repeated rows are judged each; other columns of
the input are ignored; rules with a null or empty host never fit; no rules: all get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
RULE_SCHEMA = "verdict string, host string, path string"
PREFIX_HEX = 8  # 32 bits
#: Rules up to this number are broadcast (about 200 bytes each); more go through a salted join.
BROADCAST_RULES = 100_000
SALTS = 32


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of `urls`."""
    rules = (
        rules.select("verdict", ascii_lower(F.col("host")).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"))
        .where("rhost <> ''")
        .groupBy("rhost", "rpath")
        .agg(F.max("verdict").alias("rverdict"))  # block > allow
        .withColumn("labels", F.size(F.split("rhost", r"\.", -1)))
        .withColumn("chars", F.char_length("rpath"))
        .withColumn("digest", F.sha2(F.concat("rhost", "rpath"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    # One small row for each shape of a rule, not for each rule: host labels and path lengths are
    # bounded by what DNS and browsers take.
    shapes = sorted((r[0], r[1]) for r in rules.groupBy("labels", "chars").count().select("labels", "chars").collect())
    n_rules = rules.count()

    shape = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("c")) for a, b in shapes]) if shapes else F.expr("array(struct(0 as l, 0 as c))")
    page = (
        urls.select(F.col(key).alias("k"), F.col(url).alias("u"))
        .select("k", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("n", F.size("labels"))
    )
    page = page.withColumn(
        "e",
        F.explode_outer(
            F.filter(F.lit(shape), lambda s: (F.col("host") != "") & (s["l"] <= F.col("n")) & (s["c"] <= F.char_length("path")))
        ),
    )
    page = page.withColumn(
        "expr",
        F.concat(
            F.array_join(F.slice("labels", F.col("n") - F.col("e.l") + 1, F.col("e.l")), "."),
            F.substring("path", F.lit(1), F.col("e.c")),
        ),
    ).withColumn("digest", F.sha2("expr", 256))
    page = page.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).select("k", "host", "path", "row", "digest", "short")

    side = rules.select("short", F.col("digest").alias("rdigest"), "rhost", "rpath", "rverdict")
    if n_rules <= BROADCAST_RULES:
        met = page.join(F.broadcast(side), "short", "left")
    else:  # a hot host's rows are spread over SALTS keys
        met = page.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(
            side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["short", "salt"], "left"
        )
    hit = F.col("digest") == F.col("rdigest")
    best = F.max(
        F.when(
            hit,
            F.struct(
                (F.char_length("rhost") + F.char_length("rpath")).alias("len"),
                F.char_length("rhost").alias("hlen"),
                F.col("rverdict").alias("verdict"),
                F.concat("rhost", "rpath").alias("rule"),
            ),
        )
    ).alias("best")
    return met.groupBy("row", "k", "host", "path").agg(best).select(
        F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))


ORACLE = r"""
WITH r(verdict, rh, rp) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
       ('allow','com','/fr/'), ('block','com','/de/')),
p AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT page_id, max(struct_pack(len := length(rh) + length(rp), h := length(rh), v := verdict, rule := rh || rp)) AS b
      FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT q.page_id, q.host, q.path, m.b.rule AS rule, coalesce(m.b.v, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""
