"""Cutting rows in their order into shards that keep a budget.

A shard takes rows while their costs fit; one row alone may pass the budget.  Groups of up to `FOLD_ROWS` rows are folded, one
after the other, in tasks.  Larger ones are cut without holding a group in one place: running sums of the costs tell for
each row where the shard after the one that it would begin starts, and these pointers are followed from each group's first row in
steps that double, so a group of n shards takes log2(n) joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordinal import with_running

#: Rows of a group that one task folds.
FOLD_ROWS = 50_000


def plan(costs: DataFrame, group: str, order: str, budget: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(group, order, shard) of rows (group, order, cost): whole costs of 1 or more; `order` is unique in a group."""
    rows = costs.select(group, order, F.col("cost").cast("long").alias("cost"))
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    return (_fold if most <= fold_rows else _jump)(rows, group, order, budget)


def _fold(rows: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    schema = rows.select(group, order, F.lit(0).cast("long").alias("shard")).schema

    def fold(table):
        import pyarrow as pa

        table = table.sort_by(order)
        shard, left, out = -1, 0, []
        for cost in table["cost"].to_pylist():
            if shard < 0 or cost > left:
                shard, left = shard + 1, budget
            left -= cost
            out.append(shard)
        return pa.table({group: table[group], order: table[order], "shard": pa.array(out, pa.int64())})

    return rows.groupBy(group).applyInArrow(fold, schema)


def pointers(placed: DataFrame, budget: int) -> DataFrame:
    """(g, at, to) of rows (g, at, begin, n, total): the row that begins the next shard, if one begins at `at`; none at the end."""
    # The next start is less than a budget away or is the next row: rows are met in stretches of the sums, and in the one before.
    stretch = F.floor(F.col("begin") / budget)
    spread = placed.withColumn("stretch", F.explode(F.array(stretch - 1, stretch))).withColumn("own", F.col("stretch") == stretch)
    reach = F.max("at").over(Window.partitionBy("g", "stretch").orderBy("begin").rangeBetween(0, budget))
    far = spread.withColumn("reach", reach).where("own")
    to = F.when(F.col("total") - F.col("begin") <= budget, F.col("n")).otherwise(F.greatest("reach", F.col("at") + 1))
    return far.withColumn("to", to).where("to < n").select("g", "at", "to")


def _jump(rows: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    given = rows.select(F.struct(group).alias("g"), F.col(order).alias("o"), "cost")  # a struct is equal to itself, null or not
    run = with_running(given, ["g"], ["o"], {"end": F.col("cost"), "place": F.lit(1).cast("long")})
    placed = run.select("g", "o", (F.col("place") - 1).alias("at"), (F.col("end") - F.col("cost")).alias("begin"), F.col("place_of").alias("n"), F.col("end_of").alias("total"))
    placed = stored(placed, "shard-places")
    hops = [stored(pointers(placed, budget), "shard-hops")]
    while hops[-1].where("at = 0").limit(1).count():
        last = hops[-1]
        on = last.select("g", F.col("at").alias("to"), F.col("to").alias("on"))
        hops.append(stored(last.join(on, ["g", "to"]).select("g", "at", F.col("on").alias("to")), "shard-hops"))
    starts = placed.where("at = 0").select("g", "at", F.lit(0).cast("long").alias("shard"))
    for k in range(len(hops) - 1, -1, -1):
        more = starts.join(hops[k], ["g", "at"]).select("g", F.col("to").alias("at"), (F.col("shard") + 2**k).alias("shard"))
        starts = stored(starts.unionByName(more), "shard-starts")
    # A row's shard is that of the last start before it, which is in its stretch or in the one before.
    stretch = F.floor(F.col("begin") / budget)
    marked = placed.join(starts, ["g", "at"], "left")
    both = F.when(F.col("shard").isNotNull(), F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    spread = marked.withColumn("stretch", F.explode(both)).withColumn("own", F.col("stretch") == stretch)
    upto = Window.partitionBy("g", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spread.withColumn("shard", F.max("shard").over(upto)).where("own").select(F.col(f"g.{group}").alias(group), F.col("o").alias(order), "shard")
