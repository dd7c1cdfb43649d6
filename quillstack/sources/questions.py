"""Question sets as YAML files: written a record a question, read back by records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "q string, kind string, doc string, pages array<int>, primary int, answerable boolean"
#: Where a question's labels come from: its best page's score, the corpus's answer and scope, and pages of other articles as good.
ORACLE = "struct<best:double,answerable:double,scope:double,spilled:int,from:string>"
HEADER = """# A question set: labels come from sweeps by a judge and not by hand, so look at them before you trust them.
# Pages count from 1 in their doc. Questions that are not answerable were mined from the corpus as well.
# Modes that ask the same judge are graded by their agreement with it, not by their accuracy."""


def quoted(c: Column) -> Column:
    """A YAML string in double quotes; null without."""
    slash = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(slash, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')), F.lit("null"))


def _unquoted(c: Column) -> Column:
    hold = F.lit("\u0000")
    plain = F.replace(c, F.lit("\\\\"), hold)
    plain = F.replace(F.replace(plain, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, hold, F.lit("\\"))


def records(questions: DataFrame) -> DataFrame:
    """(value): the YAML of each question; the question first, no primary page where there is none."""
    lines = [
        F.concat(F.lit("- q: "), quoted(F.col("q"))),
        F.concat(F.lit("  kind: "), F.col("kind")),
        F.concat(F.lit("  doc: "), quoted(F.col("doc"))),
        F.concat(F.lit("  pages: ["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]")),
        F.concat(F.lit("  primary: "), F.col("primary").cast("string")),
        F.concat(F.lit("  answerable: "), F.col("answerable").cast("string")),
    ]
    if "oracle" in questions.columns:
        o = lambda n: F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"oracle.{n}").cast("string"), F.lit("null")))
        said = F.concat_ws(", ", o("best"), o("answerable"), o("scope"), o("spilled"), F.concat(F.lit("from: "), quoted(F.col("oracle.from"))))
        lines.append(F.when(F.col("oracle").isNotNull(), F.concat(F.lit("  oracle: {"), said, F.lit("}"))))
    return questions.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def write(questions: DataFrame, path: str) -> None:
    """The records, in files of which the first holds the header."""
    head = questions.sparkSession.createDataFrame([(HEADER + "\n",)], "value string").coalesce(1)
    head.unionByName(records(questions)).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The questions of the files under `path`: by default a kind is spec, pages are none and an answer exists."""
    blocks = spark.read.option("lineSep", "\n- q: ").text(path).select(F.concat(F.lit("q: "), F.regexp_replace("value", "^- q: ", "")).alias("v")).where("v like 'q: \"%' or v like 'q: null%'")
    text = lambda name: F.when(F.col("v").rlike(rf'(?m)^ *{name}: "'), F.regexp_extract("v", rf'(?m)^ *{name}: "((?:[^"\\]++|\\.)*+)"', 1))
    word = lambda name: F.nullif(F.regexp_extract("v", rf"(?m)^ *{name}: *([^\n]*?) *$", 1), F.lit(""))
    # Fields of the oracle's block, in their order; its text comes last, so numbers are looked for before it.
    block = F.regexp_extract("v", r"(?m)^ *oracle: \{([^\n]*)\} *$", 1)
    part = lambda name, kind: F.nullif(F.regexp_extract(F.regexp_extract(block, r'^((?:(?! from: ).)*)', 1), rf"\b{name}: ([^,]*)", 1), F.lit("")).try_cast(kind).alias(name)
    source = F.when(block.contains('from: "'), _unquoted(F.regexp_extract(block, r'from: "((?:[^"\\]++|\\.)*+)"', 1))).alias("from")
    oracle = F.when(block != "", F.struct(part("best", "double"), part("answerable", "double"), part("scope", "double"), part("spilled", "int"), source))
    pages = F.transform(F.regexp_extract_all(F.coalesce(F.regexp_extract("v", r"(?m)^ *pages: *\[([^\]]*)\]", 1), F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int"))
    return blocks.select(
        _unquoted(text("q")).alias("q"),
        F.coalesce(word("kind"), F.lit("spec")).alias("kind"),
        _unquoted(text("doc")).alias("doc"),
        pages.alias("pages"),
        word("primary").try_cast("int").alias("primary"),
        (F.coalesce(word("answerable"), F.lit("true")) == "true").alias("answerable"),
        oracle.alias("oracle"),
    )
