"""Secret scans: fixed patterns, and sliding-window entropy with an allow-list.

Patterns: leftmost non-overlapping matches of each kind; a match that fails its length is dropped
but keeps its place.  Positions are code points: the text is split at the matches, and lengths of
gaps and matches are summed up, group of matches after group, so the work is in proportion to the text.

Entropy: candidate strings are runs of `[A-Za-z0-9+/_-]` of 20 and more with a digit, and up to two `=`
behind.  A window slides over a candidate; at each step one character enters and one leaves, two counts change and
with them the sum of c log2 c, so the window's Shannon entropy costs no recount.  Counts are five bits
each, twelve to a long, so a step is a few sums of longs however long the candidate or the alphabet is.  A
candidate is read in pieces of `PIECE` characters that overlap by a window.  Hex candidates and
others have a window and a threshold each.  The stretch from the first window over the threshold
to the last is the span, unless the allow-list knows the candidate (UUIDs, paths, numbers, words) or the
span (placeholder words), or a base span covers it.

Built of DataFrame functions only: no shuffle, no Python.

Defined results: a null text counts as empty; a text without secrets has zero counts, the SHA-256
of the empty string and ''; repeated rows are scanned each; an empty table gives an empty result;
other columns of the input are ignored; a very long text, or a candidate of any length, is scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ["assign", "access", "hex", "entropy"]
#: Character classes: alphabet, window, least entropy in bits (of log2(window) at most).
CLASSES = {
    "hex": ("0123456789abcdef", 20, 3.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.75),
}
#: Candidates that aren't secrets; no pattern repeats a group, for that would take stack by the text's length.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9+/_=-]+$",  # numbers, dates
    r"^[A-Za-z_-]+[0-9]{1,4}$",  # words with a number
]
#: All parts of a path are like this.
ALLOWED_PART = r"^[A-Za-z_-]{0,24}[0-9]{0,4}$"
#: Spans that aren't secrets, for what they hold.
ALLOWED_SPAN = r"(?i)example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh"
#: Matches whose places are summed up together; characters of a candidate that are read together.
GROUP, PIECE = 256, 4096
#: Counts of a long, and the bits of each (for windows of up to 31).
COUNTS, BITS = 12, 5


def _placed(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """`rows` with `name`: array<struct<start, end, hit>> of the pattern's matches in t."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    hits, gaps = F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(0)), F.split(F.col("t"), pattern, -1)
    rows = rows.withColumn(name, F.when(F.col("t").rlike(pattern), F.arrays_zip(hits.alias("hit"), gaps.alias("gap"))))
    n = F.size(name) - 1  # the last gap is behind the last match
    long = lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("long"), x["hit"].alias("hit"))
    groups = F.transform(F.sequence(F.lit(0), n - 1, F.lit(GROUP)), lambda i: F.transform(F.slice(name, i + 1, F.least(F.lit(GROUP), n - i)), long))
    rows = rows.withColumn(name, F.when(n > 0, groups))
    whole = lambda g: F.aggregate(g, F.lit(0), lambda at, x: at + x["gap"] + x["long"])
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    begins = F.aggregate(name, first, lambda acc, g: F.struct((acc["at"] + whole(g)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc, x):
        at = acc["at"] + x["gap"]
        hit = F.struct(at.alias("start"), (at + x["long"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((at + x["long"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    placed = F.zip_with(name, begins, lambda g, at: F.aggregate(g, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    return rows.withColumn(name, F.coalesce(F.flatten(placed), none))


def _windowed(text: Column, alphabet: str, window: int, least: float) -> Column:
    """array<struct<first, last>>, one for each piece of `text`: the stretch of the piece whose windows reach
    `least` bits; nulls if none does."""
    # A letter is the number of its long, and the place of its count there.
    codes = [0] * 128
    for i, c in enumerate(alphabet):
        codes[ord(c)] = i // COUNTS << 6 | i % COUNTS * BITS
    gain = F.lit([0.0] + [(c + 1) * math.log2(c + 1) - c * math.log2(c) for c in range(1, window + 1)])  # of c log2 c
    most = math.log2(window) - least  # entropy >= least  <=>  sum / window <= most
    shift = lambda f, x, letter: F.call_function(f, x, letter.bitwiseAND(63))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def count(acc, letter):
        return shift("shiftright", F.get(acc["counts"], F.shiftright(letter, 6)), letter).bitwiseAND((1 << BITS) - 1).cast("int")

    def marked(acc):
        """(first, last) with the window that the state stands for."""
        high = (acc["i"] >= window) & (acc["sum"] / window <= most + 1e-9)
        return F.coalesce(acc["first"], F.when(high, acc["i"] - window)).alias("first"), F.when(high, acc["i"]).otherwise(acc["last"]).alias("last")

    def step(acc, x):
        enters, leaves = x["enters"], x["leaves"]
        up = F.get(gain, count(acc, enters))
        # Counted when the other has entered: one more, if both are the same letter.
        down = F.when(leaves < 0, 0.0).otherwise(F.get(gain, count(acc, leaves) - (leaves != enters).cast("int")))
        unit = lambda letter, j: F.when(F.shiftright(letter, 6) == j, shift("shiftleft", one, letter)).otherwise(zero)
        counts = F.transform(acc["counts"], lambda n, j: n + unit(enters, j) - unit(leaves, j))
        return F.struct(counts.alias("counts"), (acc["sum"] + up - down).alias("sum"), (acc["i"] + 1).alias("i"), *marked(acc))

    nothing = F.lit(None).cast("int")
    start = F.struct(F.lit([0] * -(-len(alphabet) // COUNTS)).cast("array<long>").alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), nothing.alias("first"), nothing.alias("last"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    letters = F.transform(pieces, lambda p: F.transform(F.split(p, ""), lambda c: F.get(F.lit(codes), F.ascii(c))))
    before = lambda x: F.slice(F.concat(F.array_repeat(F.lit(-1), window), x), F.lit(1), F.size(x))
    moves = F.transform(letters, lambda x: F.arrays_zip(x.alias("enters"), before(x).alias("leaves")))
    return F.transform(moves, lambda m: F.aggregate(m, start, step, lambda acc: F.struct(*marked(acc))))


def _entropy(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with array<struct<start, end>> of the candidates in `name` that look random."""

    def allowed(x):
        part = F.contains(x["hit"], F.lit("/")) & F.forall(F.split(x["hit"], "/", -1), lambda p: p.rlike(ALLOWED_PART))
        for p in ALLOWED:
            part = part | x["hit"].rlike(p)
        return part

    def read(x):
        hit = x["hit"]
        got = F.when(hit.rlike("^[0-9a-fA-F]+=*$"), _windowed(F.lower(F.regexp_replace(hit, "=+$", "")), *CLASSES["hex"])).otherwise(_windowed(hit, *CLASSES["base64"]))
        return F.struct(x["start"].alias("start"), hit.alias("hit"), got.alias("of"))

    rows = rows.withColumn(name, F.transform(F.filter(name, lambda x: ~allowed(x)), read))
    place = lambda x, which: F.transform(x["of"], lambda w, i: w[which] + i * PIECE)
    spans = F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["hit"].alias("hit"), F.array_min(place(x, "first")).alias("first"), F.array_max(place(x, "last")).alias("last")))
    kept = F.filter(spans, lambda x: x["first"].isNotNull() & ~F.substring(x["hit"], x["first"] + 1, x["last"] - x["first"]).rlike(ALLOWED_SPAN))
    return rows.withColumn(name, F.transform(kept, lambda x: F.struct((x["start"] + x["first"]).alias("start"), (x["start"] + x["last"]).alias("end"))))


def _uncovered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with the entropy spans of `name` (sorted, of all kinds) that no base span covers: those that end
    behind all base spans which began before them."""
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int>>)")
    n = F.size(name)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(GROUP)), lambda i: F.slice(name, i + 1, GROUP))
    rows = rows.withColumn(name, groups)
    end = lambda g: F.coalesce(F.array_max(F.transform(F.filter(g, lambda s: s["ord"] < 3), lambda s: s["end"])), F.lit(-1))
    first = F.struct(F.lit(-1).alias("top"), F.expr("cast(array() as array<int>)").alias("out"))
    tops = F.aggregate(name, first, lambda acc, g: F.struct(F.greatest(acc["top"], end(g)).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out")), lambda acc: acc["out"])

    def step(acc, s):
        top, out, base = acc["top"], acc["out"], s["ord"] < 3
        return F.struct(F.when(base, F.greatest(top, s["end"])).otherwise(top).alias("top"), F.when(base | (s["end"] <= top), out).otherwise(F.concat(out, F.array(s))).alias("out"))

    kept = F.zip_with(name, tops, lambda g, top: F.aggregate(g, F.struct(top.alias("top"), none.alias("out")), step, lambda acc: acc["out"]))
    return rows.withColumn(name, F.flatten(kept))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, extra): arrays of (start, ord, end), ord being the place in KINDS."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for name, pattern in (("a", ASSIGN), ("c", ACCESS), ("x", HEX), ("e", CANDIDATE)):
        rows = _placed(rows, name, pattern)
    rows = rows.drop("t")
    kind = lambda column, n: F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("ord"), s["end"].alias("end")))
    long_enough = F.filter(F.col("a"), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 8)
    rows = rows.select("k", "e", F.array_sort(F.concat(kind(long_enough, 0), kind(F.col("c"), 1), kind(F.col("x"), 2))).alias("base"))
    rows = _entropy(rows, "e")
    rows = rows.select("k", "base", F.array_sort(F.concat("base", kind(F.col("e"), 3))).alias("e"))
    return _uncovered(rows, "e").select(F.col("k").alias(key), "base", F.col("e").alias("extra"))


def listed(spans: Column) -> Column:
    name = lambda n: F.element_at(F.lit(KINDS), n + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
