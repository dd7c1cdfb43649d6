"""Queries by name, and the SQL that says the same.

`query` registers a DataFrame plan with its own SQL.  `shared` registers one text for both engines:
where their dialects differ it has a name in angle brackets, told by `DIALECTS`.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read

_kept: dict[str, tuple[str, DataFrame]] = {}
QUERIES: dict = {}
SQL: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: <name(a;b)> in a shared text; arguments are parted by semicolons.
DIALECTS = {
    "spark": {
        "div": "(({0}) div ({1}))", "sha": "sha2({0}, 256)", "series": "sequence({0}, {1})", "unnest": "explode_outer({0})", "int": "CAST({0} AS INT)",
        "long": "CAST({0} AS BIGINT)", "agg": "array_join(transform(array_sort(collect_list(struct({2}, {0}))), x -> x.{0}), {1})", "alln": "regexp_extract_all({0}, {1}, 0)",
        "each": "transform({0}, x -> {1})", "only": "filter({0}, x -> {1})", "any": "exists({0}, x -> {1})", "join": "array_join({0}, {1})", "len": "CAST(size({0}) AS BIGINT)",
        "part": "split({0}, {1}, -1)", "distinct": "array_distinct({0})", "at": "element_at({0}, {1})", "json": "get_json_object({0}, '$.{1}')", "has": "contains({0}, {1})",
        "like": "({0} RLIKE {1})", "swap": "regexp_replace({0}, {1}, {2})", "sortset": "array_sort(collect_set({0}))", "slice": "slice({0}, 1, {1})", "has_item": "array_contains({0}, {1})",
        "epoch": "unix_micros(CAST({0} AS TIMESTAMP))", "dot": "aggregate(zip_with({0}, {1}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0e0, (s, p) -> s + p)", "trim": "btrim({0}, {1})", "slot": "regexp_replace({0}, {1}, {2})", "date": "date_format({0}, 'yyyy-MM-dd')",
    },
    "duck": {
        "div": "(({0}) // ({1}))", "sha": "sha256({0})", "series": "generate_series({0}, {1})", "unnest": "unnest({0})", "int": "CAST({0} AS INT)",
        "long": "CAST({0} AS BIGINT)", "agg": "string_agg({0}, {1} ORDER BY {2}, {0})", "alln": "regexp_extract_all({0}, {1})",
        "each": "list_transform({0}, lambda x: {1})", "only": "list_filter({0}, lambda x: {1})", "any": "(len(list_filter({0}, lambda x: {1})) > 0)", "join": "array_to_string({0}, {1})", "len": "CAST(len({0}) AS BIGINT)",
        "part": "string_split({0}, {1})", "distinct": "list_distinct({0})", "at": "list_extract({0}, {1})", "json": "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.{1}') END", "has": "contains({0}, {1})",
        "like": "regexp_matches({0}, {1})", "swap": "regexp_replace({0}, {1}, {2}, 'g')", "sortset": "list_sort(list_distinct(list({0})))", "slice": "list_slice({0}, 1, {1})", "has_item": "list_contains({0}, {1})",
        "epoch": "epoch_us({0})", "dot": "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))", "trim": "trim({0}, {1})", "slot": "regexp_replace({0}, {1}, {2})", "date": "strftime({0}, '%Y-%m-%d')",
    },
}
_CALL = re.compile(r"<(\w+)\(((?:[^<>]|<>|<=|>=|->| < | > )*?)\)>")


def told(text: str, dialect: str) -> str:
    """`text` in one engine's dialect; inner calls are told first."""
    names = DIALECTS[dialect]
    while (new := _CALL.sub(lambda m: names[m[1]].format(*m[2].split(";")), text)) != text:
        text = new
    return text


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            read(spark, sf_dir, t).createOrReplaceTempView(t)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = told(sql, "duck")
        return f

    return put


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    said = told(text, "spark")
    views(spark, sf_dir, said)
    return spark.sql(said.replace("\\", "\\\\"))


def keep(name: str, df: DataFrame) -> DataFrame:
    """`df`, made once and kept.  Made anew for each query, as the folder's tables may have changed; the one before of
    this name is let go."""
    app, before = _kept.pop(name, (None, None))
    if app == df.sparkSession.sparkContext.applicationId:
        before.unpersist()
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept[name] = df.sparkSession.sparkContext.applicationId, df
    return df


_keep = keep  # `shared` has an argument of this name


def shared(name: str, text: str, keep: tuple | None = None) -> None:
    """`keep`: (common tables that the text begins with, the last one's name), which several parts
    of the text read: Spark makes it once and keeps it, for it would be put in each place anew.  With a third, a
    function of (spark, sf_dir), it is that operator's result and not the text's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not keep:
            return spark_sql(spark, sf_dir, text)
        begin, last, *made = keep
        df = _keep(last, made[0](spark, sf_dir) if made else spark_sql(spark, sf_dir, f"WITH {begin} SELECT * FROM {last}"))
        df.createOrReplaceTempView(f"kept_{last}")
        return spark_sql(spark, sf_dir, text.replace(begin, f"{last} AS (SELECT * FROM kept_{last})"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = told(text, "duck")
