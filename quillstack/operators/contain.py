"""Which pages hold stated texts, and how many of stated words: each page is read once for all of them.

Items are told to the tasks in blocks of a bounded size, mostly one; more of them take one more pass a block."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Workers may not have this package: what they run of this module goes along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of items, and 32 for each, that are told to tasks at once.
BLOCK_CHARS = 1 << 23


def _blocks(items: DataFrame, size) -> list[list]:
    """The rows of `items` in blocks of about `BLOCK_CHARS` by `size`: each block alone comes to the driver."""
    total = items.agg(F.sum(size + 32)).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    place = F.pmod(F.xxhash64("item", "s"), F.lit(max(1, n)))
    return (items.where(place == i).collect() for i in range(n))


def _linked(spark, found: list[DataFrame], links: list, items: DataFrame, pages: DataFrame, *more) -> DataFrame:
    """The parts' rows (no, key, ..) with the items that their numbers stand for."""
    kind = StructType([StructField("no", LongType()), items.schema["item"]])
    parts = [f.join(F.broadcast(spark.createDataFrame(of, kind)), "no").select("item", "key", *more) for f, of in zip(found, links)]
    if not parts:
        return items.select("item").join(pages.select("key"), how="cross").limit(0).select("item", "key", *(F.lit(0).cast("long").alias(c) for c in more))
    return reduce(DataFrame.unionByName, parts)


def containing(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(item, key) of the pages (key, text) that hold the text of (item, s), both read in small letters, found for all items
    in one pass by an Aho-Corasick automaton.  An empty text is in every page that has one, a null one in none."""
    spark = pages.sparkSession
    asked = items.select("item", F.lower("s").alias("s")).where("s IS NOT NULL")
    low = pages.select("key", F.lower("text").alias("t")).where("t IS NOT NULL")
    kind = pages.schema["key"].dataType.simpleString()
    found, links = [], []
    for block in _blocks(asked.where("s <> ''"), F.char_length("s")):
        numbers = {s: i for i, s in enumerate(sorted({r.s for r in block}))}
        links.append([(numbers[r.s], r.item) for r in block])
        found.append(low.mapInArrow(_finder(spark.sparkContext.broadcast(list(numbers))), f"no long, key {kind}"))
    out = _linked(spark, found, links, items, pages)
    empty = asked.where("s = ''")
    return out.unionByName(low.select("key").join(F.broadcast(empty), how="cross").select("item", "key")) if empty.limit(1).count() else out


def _finder(told):
    def work(batches):
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for i, s in enumerate(told.value):
            machine.add_word(s, i)
        machine.make_automaton()
        for b in batches:
            at, numbers = [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                got = {i for _, i in machine.iter(t)}
                numbers += got
                at += [row] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], names=["no", "key"])

    return work


def overlaps(pages: DataFrame, items: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """(item, key, n, of): how many of the `of` words of (item, words) the page (key, words) has, both arrays without repeats.

    Of all pairs those that have a share of `least` or more, and for each item its best pairs of a batch, the first
    keys' of equals: what an item's best page is can be told, and nothing is made for each pair that shares a word.  With `most`, of those
    of a share of `least` or more only each item's so many best of a batch, in the same order."""
    spark = pages.sparkSession
    asked = items.select("item", F.array_join("words", " ").alias("s"), "words")
    kind = pages.schema["key"].dataType.simpleString()
    found, links = [], []
    for block in _blocks(asked, F.char_length("s")):
        links.append([(i, r.item) for i, r in enumerate(block)])
        told = spark.sparkContext.broadcast([r.words for r in block])
        found.append(pages.select("key", "words").mapInArrow(_counter(told, least, most), f"no long, key {kind}, n long, of long"))
    return _linked(spark, found, links, items, pages, "n", "of")


def _counter(told, least: float, most: int | None = None):
    def work(batches):
        import collections

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        holders = collections.defaultdict(list)
        of = np.array([len(w) for w in told.value], np.int64)
        for i, words in enumerate(told.value):
            for w in words:
                holders[w].append(i)
        needed = np.maximum(1, np.ceil(least * of - 1e-9)).astype(np.int64)
        for b in batches:
            numbers, at, n = [], [], []
            best, where = np.zeros(len(of), np.int64), np.full(len(of), -1)
            keys = b.column(0)
            for row in pc.sort_indices(keys, null_placement="at_start").to_pylist():
                words = b.column(1)[row].as_py() or ()
                got = collections.Counter(i for w in words if w in holders for i in holders[w])
                if not got:
                    continue
                i, c = np.fromiter(got, np.int64, len(got)), np.fromiter(got.values(), np.int64, len(got))
                up = c > best[i]
                best[i[up]], where[i[up]] = c[up], row
                enough = c >= needed[i]
                numbers += i[enough].tolist()
                n += c[enough].tolist()
                at += [row] * int(enough.sum())
            if most is not None:
                # Rows are in the keys' order, which a stable sort keeps.
                no, c = np.array(numbers, np.int64), np.array(n, np.int64)
                by = np.lexsort((-c, no))
                few = by[np.arange(len(by)) - np.searchsorted(no[by], no[by]) < most]
                numbers, at, n = no[few].tolist(), np.array(at, np.int64)[few].tolist(), c[few].tolist()
            more = np.flatnonzero((best > 0) & (best < needed))
            numbers, at, n = numbers + more.tolist(), at + where[more].tolist(), n + best[more].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), keys.take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(of[numbers] if numbers else [], pa.int64())], names=["no", "key", "n", "of"])

    return work
