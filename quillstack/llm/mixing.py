"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources share `TOTAL` of all words by weight; a target stops at `REPEATS` times its
source's size, and the excess is shared again, until none is above.  (That is one level L with
target = least(weight * L, REPEATS * size); each round of `level` sums up the sources once.)

Blocks: a source's documents, shuffled by a hash, are one stream of words, cut into equal blocks
of `BLOCK` words (fewer for a small source, so that it has many blocks).

Schedule: slot k has the point frac((k + 1/2) * golden ratio); cumulative weights (the sources' targets
in blocks) say whose slot it is.  A source's slots are ranked in order, and rank r takes the source's
block at the shuffled place of r: each pass over the blocks is another permutation.  So the points
alone decide how many blocks a source gives, which ones and when: counts come within a few blocks of
the targets, as low-discrepancy points do.  Ranks behind the last of `REPEATS` passes are left out.

Sources may be many: they are numbered by ranges, summed up in ranges, and met with the slots by cells
of the unit interval, so no list of them is on the driver.  Ranks run over chunks of slots, whose totals are
summed up for each source.  Built of DataFrame functions only.

Defined results: a null text has size 0; a null source is a source, last in order; a source of
size 0 has target 0; sources are in order of code points; repeated rows are separate documents
(their takes may be swapped); an empty table gives an empty result; other columns are ignored;
a very long document spans many blocks; a document that no slot takes has taken 0 and no first slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, if_few, stored, table

WEIGHTS = (3, 1, 2)
TOTAL, REPEATS = 1.5, 2
BLOCK, LEAST_BLOCKS = 1024, 512
BUCKET_DOCS, CHUNK = 4096, 1 << 14
#: Equal rows that one task makes of a stretch.
COPIES = 1024
#: Sources of one range; up to so many sources (or cells) are broadcast, about 100 bytes each.
RANGE_SOURCES, BROADCAST_SOURCES = 50_000, 10_000
#: Cells of the unit interval: four for each source, but no more than this.
CELLS = 1 << 20
#: Steps in which a place behind the last block gets before it.
WALK = 64
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden(slot: Column) -> Column:
    """The point of a slot.  The ratio is a fraction of 2^32, and slots are read in two parts, so no
    product passes a long and points stay even for any number of slots."""
    whole = round(GOLDEN * (1 << 32))
    low = F.pmod((slot % (1 << 31)) * F.lit(whole), F.lit(1 << 32)) / F.lit(float(1 << 32))
    high = F.floor(slot / (1 << 31)) * F.lit(0.5 * (whole % 2))
    return F.pmod(low + high + F.lit(GOLDEN / 2), F.lit(1.0))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], part: str = "part") -> DataFrame:
    """`rows` with the sum of earlier rows of each of `sums` (new column: column), in `order` over all
    parts; `part` numbers ranges of that order, and only their totals meet."""
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*(F.sum(c).alias(f"{n}_of") for n, c in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, *(F.coalesce(F.sum(f"{n}_of").over(before), F.lit(0)).alias(f"{n}_base") for n in sums))
    met = rows.join(F.broadcast(bases), part)  # a row for each range
    return met.select(*rows.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{n}_base")).alias(n) for n, c in sums.items()))


def level(sources: DataFrame, total: float, repeats: float) -> float:
    """L of least(weight * L, repeats * size), from (weight, size): sources full at the level so far give
    what they have, the others share the rest; until no further one is full."""
    words_ = sources.agg(F.sum("size")).first()[0] or 0
    at, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(at) > repeats * F.col("size")
        r = sources.agg(F.sum(F.when(is_full, F.col("size")).otherwise(0)), F.sum(F.when(is_full, 0).otherwise(F.col("weight"))), F.sum(is_full.cast("long"))).first()
        if r[2] == full or not r[1]:
            return at
        full, at = r[2], (total * words_ - repeats * r[0]) / r[1]


def source_plans(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """(s, src, source_size, target, block, blocks, slots, buckets, low, high) of (src, size, docs): each
    source's number, target, blocks and part of the unit interval, as cumulative weights."""
    parts = max(1, -(-sources.count() // RANGE_SOURCES))
    dealt = stored(sources.repartitionByRange(parts, F.asc_nulls_last("src")).withColumn("part", F.spark_partition_id()), "mix-sources")
    order = [F.asc_nulls_last("src")]
    rows = _running(dealt.withColumn("one", F.lit(1)), order, {"s": "one"}).drop("one")
    weight = F.element_at(F.lit(list(weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumn("weight", weight), "mix-weights")
    top = level(rows, total, repeats)
    target = F.least(F.col("weight") * F.lit(top), repeats * F.col("size").cast("double"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(target / LEAST_BLOCKS))).cast("int")
    rows = rows.withColumn("target", target).withColumn("block", block).withColumn("blocks", F.ceil(F.col("size") / F.col("block")))
    rows = rows.withColumn("slots", F.round(F.col("target") / F.col("block")).cast("long")).withColumn("buckets", F.ceil(F.col("docs") / BUCKET_DOCS))
    rows = stored(_running(rows, order, {"low": "slots"}), "mix-plans")
    return rows.select("s", "src", F.col("size").alias("source_size"), "target", "block", "blocks", "slots", "buckets", "low", (F.col("low") + F.col("slots")).alias("high"))


def schedule(plans: DataFrame, points=golden, repeats: int = REPEATS) -> DataFrame:
    """(s, rank, slot, blocks): whose each slot of the mix is, and its place among the source's slots."""
    spark = plans.sparkSession
    total = plans.agg(F.sum("slots"), F.count("*")).first()
    n, many = total[0] or 0, total[1]
    cells = max(1, min(4 * many, CELLS))
    # Each source's interval meets the cells that it touches; a slot's cell has all that can be its source.
    of = lambda edge: F.least(F.floor(edge / F.lit(float(max(n, 1))) * cells), F.lit(cells - 1))
    where = plans.where("slots > 0").select("s", "blocks", "low", "high", F.explode(F.sequence(of(F.col("low")), of(F.col("high")))).alias("cell"))
    where = F.broadcast(where) if cells + many <= BROADCAST_SOURCES else where
    at = points(F.col("id")) * F.lit(float(n))
    slots = spark.range(n).select(F.col("id").alias("slot"), at.alias("at"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("at") / F.lit(float(max(n, 1))) * cells), F.lit(cells - 1)))
    slots = slots.join(where, "cell").where("at >= low and at < high").select("s", "blocks", "slot", "chunk")
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = slots.groupBy("s", "chunk").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("s", "chunk", "base")
    inside = Window.partitionBy("s", "chunk").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(inside).cast("long")).join(chunks, ["s", "chunk"])
    ranked = ranked.select("s", "blocks", (F.col("base") + F.col("r") - 1).alias("rank"), "slot")
    return ranked.where(F.col("rank") < repeats * F.col("blocks"))


def shuffled(rank: Column, blocks: Column, seed: int) -> Column:
    """Place of a rank's block: in each pass the ranks go over all blocks, in another order.

    A place is read as two digits to the base m, the least with m * m >= blocks; in turn one digit moves by a
    hash of the other, which can be undone, so places stay different.  One behind the last block is moved on until
    it is before it: at most 2 m are behind, so for m up to 32 this ends within `WALK` steps, and for
    larger m each step goes on with a chance under 2 / m."""
    m = F.ceil(F.sqrt(blocks.cast("double")))
    turn = F.floor(rank / blocks)

    def moved(place: Column) -> Column:
        digits = F.struct(F.floor(place / m).alias("a"), F.pmod(place, m).alias("b"))
        step = lambda p, i: F.struct(p["b"].alias("a"), F.pmod(p["a"] + F.pmod(F.xxhash64(p["b"], i, turn, F.lit(seed)), m), m).alias("b"))
        return F.aggregate(F.lit([1, 2, 3, 4]), digits, step, lambda p: p["a"] * m + p["b"])

    return F.aggregate(F.lit([True] + [False] * WALK), F.pmod(rank, blocks), lambda x, first: F.when(first | (x >= blocks), moved(x)).otherwise(x))


def row_hash(key: str, text: str, seed: int = 11) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.octet_length(F.col(text)), F.col(text))


def copies(rows: DataFrame, piece: int | None = None) -> DataFrame:
    """Each of `rows` (.., size, times, start) as often as it is, one copy behind the other; many copies are dealt to several tasks."""
    piece, none = piece or COPIES, F.array(F.lit(0).cast("long"))
    pieces = F.when(F.col("times") > piece, F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / piece))).otherwise(none)
    rows = rows.withColumn("piece", F.explode(pieces))
    often = rows.where(F.col("times") > piece)
    dealt = often.repartition(F.col("h"), F.col("piece")) if often.limit(1).count() else None
    rows = rows.where(F.col("times") <= piece)
    rows = rows if dealt is None else rows.unionByName(dealt)
    last = F.least(F.col("times") - F.col("piece") * piece, F.lit(piece)) - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("start", F.col("start") + (F.col("copy") + F.col("piece") * piece) * F.col("size")).drop("piece", "copy", "times")


def mix_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS, seed: int = 11, points=golden) -> DataFrame:
    """(k, h, size, source_size, target, taken, at) of every row: its key, its `row_hash` and its part in the mix;
    at has the first slot that takes it in each pass (nulls behind the last)."""
    light = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("src"), words(F.col(text)).alias("size"), row_hash(key, text, seed).alias("h"))
    light = stored(light, "mix-sizes")
    plans = source_plans(light.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), weights, total, repeats)
    few = (F.broadcast if plans.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else lambda df: df)(plans)
    # Equal rows are one stretch of the stream, as often as they are: a row that is a third of all is in no task whole.
    once = light.groupBy("src", "k", "h", "size").agg(F.count("*").alias("times"))
    rows = once.join(few, once["src"].eqNullSafe(plans["src"])).drop("src")
    # Place of each document in its source's stream: buckets by hash, a running sum in each.
    rows = rows.withColumn("bucket", F.pmod("h", "buckets"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("s", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("s", "bucket", "base")
    running = Window.partitionBy("s", "bucket").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("times")).over(running), F.lit(0))).join(base, ["s", "bucket"])
    rows = copies(rows.withColumn("start", F.col("base") + F.col("own"))).withColumn("end", F.col("start") + F.col("size"))
    rows = stored(rows.select("k", "s", "size", "source_size", "target", "block", "h", "start", "end"), "mix-places")
    # Uses of each block, from the schedule: `repeats` slots at most.
    uses = schedule(plans, points, repeats).withColumn("b", shuffled(F.col("rank"), F.col("blocks"), seed))
    uses = uses.groupBy("s", "b").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))
    parts = rows.where("size > 0").withColumn("b", F.explode(F.sequence(first, last)))
    share = F.least("end", (F.col("b") + 1) * F.col("block")) - F.greatest("start", F.col("b") * F.col("block"))
    met = parts.join(uses, ["s", "b"])
    took = met.groupBy("s", "start").agg(F.sum(share * F.least(F.size("slots"), F.lit(repeats))).alias("taken"), F.array(*(F.min(F.get("slots", F.lit(i))) for i in range(repeats))).alias("at"))
    own = ["k", "h", "size", "source_size", "target"]
    none = F.array_repeat(F.lit(None).cast("long"), repeats)
    out = rows.where("size > 0").join(took, ["s", "start"], "left").select(*own, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("at", none).alias("at"))
    return out.unionByName(rows.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), none.alias("at")))


def mix(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, size, source_size, target, taken, first_slot) of every row; slots are the mix's order."""
    return mix_rows(docs, key, **how).select(F.col("k").alias(key), "size", "source_size", "target", "taken", F.get("at", F.lit(0)).alias("first_slot"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 11, repeats: int = REPEATS, **how) -> DataFrame:
    """`docs` as the mix takes them, in order of its slots: each row as often as its words are taken, a
    copy at the first slot of each pass.  What is left of a whole number is rounded by the row's hash, so a source's
    rows add up to about its target.  Partition after partition, rows are in order."""
    took = mix_rows(docs, key, text, seed=seed, repeats=repeats, **how).where("taken > 0")
    firsts = F.array(*(F.min(F.get("at", F.lit(i))) for i in range(repeats)))
    took = took.groupBy("k", "h").agg(F.avg(F.col("taken") / F.col("size")).alias("times"), firsts.alias("at"))
    part = F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))
    copies = F.slice("at", F.lit(1), F.floor(F.col("times") + part).cast("int"))
    k, h, slot, row = (fresh(docs, n) for n in ("k", "h", "slot", "row_hash"))
    took = took.select(F.col("k").alias(k), F.col("h").alias(h), F.explode(F.filter(copies, lambda x: x.isNotNull())).alias(slot))
    rows = docs.withColumn(row, row_hash(key, text, seed))
    took = if_few(stored(took, "mix-copies"))
    met = rows.join(took, (F.col(row) == F.col(h)) & F.col(key).eqNullSafe(F.col(k)))
    to = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartitionByRange(to, slot, h, key).sortWithinPartitions(slot, h, key).select(*docs.columns)


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
