"""Equal rows in the mix: one stretch, dealt over tasks."""

import collections

from pyspark.sql import functions as F

from quillstack.llm import mixing


def test_copies_lie_one_behind_the_other(spark):
    rows = spark.createDataFrame([("a", 1, 10, 5000, 100), ("b", 2, 3, 1, 7), ("c", 3, 0, 130, 9), ("d", 4, 2, 64, 0)], "k string, h long, size long, times long, start long")
    got = mixing.copies(rows, piece=64)
    want = [(k, s + i * z) for k, _, z, n, s in [tuple(r) for r in rows.collect()] for i in range(n)]
    assert sorted(tuple(r) for r in got.select("k", "start").collect()) == sorted(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else such few rows are put together again
    try:
        tasks = [r["count"] for r in got.where("k = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 3 and max(tasks) < 2500


def test_a_row_that_is_a_third_of_all(spark, monkeypatch):
    """Each copy takes its own part: sums are those of rows that differ."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [(i, f"{i} " + "w " * (i % 9), "s1" if i % 4 else "s2") for i in range(1000)] + [(7, "same words here", "s1")] * 500
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 1500 and sum(r.size == 3 and r.doc_id == 7 for r in got) >= 500
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + 20
    # Copies are different places of the stream, so all are not taken alike.
    firsts = [r.first_slot for r in got if r.doc_id == 7 and r.size == 3 and r.first_slot is not None]
    assert len(set(firsts)) > 100
