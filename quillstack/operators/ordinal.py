"""Places and running sums in a global order, or in groups, without sorting all rows in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal", parts: int | None = None) -> tuple[DataFrame, int]:
    """`rows` with their place (from 0) in `order`, and how many they are.

    Rows are dealt by ranges; places in a range are counted there, and the ranges' sizes, one number
    each, say where a range begins.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Kept: the ranges come from a sample that another run would draw anew, and both uses need the same.
    dealt = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    begins, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        begins.append(n)
        n += sizes.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    begin = F.element_at(F.lit(begins or [0]), F.col("__part") + 1)
    return dealt.withColumn(name, (inside + begin).cast("long")).drop("__part"), n


def with_running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`rows` with running sums, up to and with each row in `order` in its group, by name, and the group's sums as `<name>_of`.

    Rows are dealt by ranges of both, so a large group is many tasks'; a group's sums in the ranges that
    it spans, a row for each, say what comes before its part of a range.  Nulls count as nothing."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.withColumns({f"__{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    # Kept: the ranges come from a sample that another run would draw anew, and both uses need the same.
    dealt = given.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    each = dealt.groupBy(*group, "__part").agg(*(F.sum(f"__{n}").alias(n) for n in sums))
    upto, whole = Window.partitionBy(*group).orderBy("__part"), Window.partitionBy(*group)
    before = each.select(*group, "__part", *(c for n in sums for c in ((F.sum(n).over(upto) - F.col(n)).alias(f"__before_{n}"), F.sum(n).over(whole).alias(f"{n}_of"))))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"__inside_{n}": F.sum(f"__{n}").over(inside) for n in sums})
    same = summed["__part"] == before["__part"]
    for g in group:
        same = same & summed[g].eqNullSafe(before[g])
    met = summed.join(before, same)
    return met.select(*(summed[c] for c in rows.columns), *(c for n in sums for c in ((F.col(f"__inside_{n}") + F.col(f"__before_{n}")).alias(n), F.col(f"{n}_of"))))


def with_group_ordinal(rows: DataFrame, group: list[str], order: list[str], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """`rows` with their place (from 0) in `order` in their group, and the group's size as `<name>_of`; as `with_running`."""
    return with_running(rows, group, order, {name: F.lit(1).cast("long")}, parts).withColumn(name, F.col(name) - 1)


def nearest_rank(percent: int, n):
    """Place (from 0) of a percentile: round(percent / 100 * n) - 1, halves to even, inside the group."""
    whole, rest = F.floor(F.lit(percent) * n / 100), F.pmod(F.lit(percent) * n, F.lit(100))
    near = whole + F.when((rest > 50) | ((rest == 50) & (F.pmod(whole, F.lit(2)) == 1)), 1).otherwise(0)
    return F.least(n - 1, F.greatest(F.lit(0), near - 1))
