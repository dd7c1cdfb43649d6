"""Exact inner-product search, and its roll-up to pages."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.shared import stored

# Workers may not have this package: what they run of this module goes along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AGREEMENT, GIST_BONUS, RRF_K = 0.18, 1.0, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Dimensions that one step of a product adds: more terms make a function that the JVM doesn't compile.
STEP = 16
#: Rows of the smallest sample that bounds are taken from, how many times as many the next one has, and pairs of one task.
SAMPLE_ROWS, SAMPLE_STEP, TASK_PAIRS = 2048, 16, 32_000_000
#: Pairs from which on blocks of them are multiplied as matrices, or sketches are made: fewer are multiplied sooner one by one.
SKETCH_PAIRS = 30_000_000
#: Vectors of a part that meets a block of queries, queries that are multiplied at once, and vectors that the first bars are taken from.
PART_ROWS, SLICE, HEAD = 32_768, 128, 2048
#: Bits of a sketch's levels at most, dimensions of one of its words, and words' products of one comparison at most: more
#: make a function that the JVM doesn't compile.
SKETCH_BITS, SKETCH_WORD, SKETCH_TERMS = 5, 64, 100


def _met(vectors: DataFrame, queries: DataFrame, max_queries: int, by: str | None = None) -> DataFrame:
    """Every vector (vec_id, embedding) beside every other query (q, qv), which are a stated set; or with every query of
    the same `by`, its own row or not.

    Up to `max_queries` are broadcast.  More are cut into blocks of so many, and the vectors into parts: a
    part meets a block by an equi-join on both numbers, so no side is copied to all tasks at once."""
    n, keys = queries.count(), [by] if by else []
    if n <= max_queries:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        dealt = vectors.repartition(cores * min(max(1, -(-vectors.count() * n // (TASK_PAIRS * cores))), 100))  # whole rounds of tasks
        return dealt.join(F.broadcast(queries), by) if by else dealt.join(F.broadcast(queries), dealt["vec_id"] != queries["q"])
    blocks, parts = -(-n // max(1, max_queries)), max(vectors.rdd.getNumPartitions(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    asked = queries.withColumn("block", place("q", blocks)).withColumn("part", every(parts))
    met = vectors.withColumn("part", place("vec_id", parts)).withColumn("block", every(blocks)).join(asked, ["block", "part", *keys]).drop("block", "part")
    return met if by else met.where(F.col("vec_id") != F.col("q"))


def _folded(met: DataFrame, lengths: list[int]) -> DataFrame:
    """`met` with s0, s1, ..: products of the first dimensions of any two arrays, by a fold."""
    for i, n in enumerate(lengths):
        begin = lengths[i - 1] if i else 0
        part = F.zip_with(F.slice("embedding", begin + 1, n - begin), F.slice("qv", begin + 1, n - begin), lambda x, y: x.cast("double") * y.cast("double"))
        met = met.withColumn(f"s{i}", F.aggregate(part, F.col(f"s{i - 1}") if i else F.lit(0.0), lambda s, x: s + x))
    return met.drop("embedding", "qv")


def _stepped(met: DataFrame, lengths: list[int], width: int) -> DataFrame:
    """The same for arrays of `width` doubles without nulls, added in the same order.  Each step is a generator of one row,
    which keeps it a function of its own: the compiled code takes about a thirtieth of the fold's time."""
    sum_, at = "0e0", 0
    for i, n in enumerate(lengths):
        for to in [*range(at + STEP, min(n, width), STEP), min(n, width)]:
            sum_ = " + ".join([sum_, *(f"embedding[{x}] * qv[{x}]" for x in range(at, to))])
            met, sum_, at = met.select(*[c for c in met.columns if c != "s"], F.expr(f"explode(array({sum_})) AS s")), "s", to
        met = met.withColumn(f"s{i}", F.col("s"))
    return met.drop("embedding", "qv", "s")


def _words(lengths: list[int], width: int) -> list[tuple[int, int]]:
    """Stretches of dimensions, none over the end of a length."""
    ends = sorted({min(n, width) for n in lengths} | {width})
    return [(a, min(a + SKETCH_WORD, end)) for begin, end in zip([0, *ends], ends) for a in range(begin, end, SKETCH_WORD)]


def _sketch_bits(lengths: list[int], width: int) -> int:
    """Bits of a level, so many that the comparison is compiled; below two there is no sketch."""
    met = sum(to <= min(n, width) for n in lengths for _, to in _words(lengths, width))
    return max((b for b in range(2, SKETCH_BITS + 1) if b * b * met <= SKETCH_TERMS), default=0)


def _sketched(df: DataFrame, c: str, lengths: list[int], width: int, side: str) -> DataFrame:
    """`df` with the sketch of its arrays of `width` finite doubles: each dimension's level of 2^bits between its array's extremes,
    a long for each bit of a word of levels; and for each length the norms of the vector that the levels stand for (or, of
    queries, of the vector itself) and of what they leave."""
    half, step = 1 << (_sketch_bits(lengths, width) - 1), f"{side}step"
    top = f"greatest(array_max({c}), -array_min({c}))"
    out = df.withColumn(step, F.expr(f"CASE WHEN {top} > 1e-290 THEN {top} / {half}e0 ELSE 1e0 END"))
    out = out.withColumn("__levels", F.expr(f"transform({c}, x -> least(greatest(floor(x / {step}), -{half}L), {half - 1}L))"))
    out = out.withColumn("__near", F.expr(f"transform(__levels, x -> (x + 5e-1) * {step})")).withColumn("__left", F.expr(f"zip_with({c}, __near, (x, y) -> x - y)"))
    made = {}
    for w, (a, b) in enumerate(_words(lengths, width)):
        for i in range(half.bit_length()):
            made[f"{side}{w}_{i}"] = f"aggregate(slice(__levels, {a + 1}, {b - a}), 0L, (s, x) -> shiftleft(s, 1) | (shiftright(x, {i}) & 1L))"
    for i, n in enumerate(min(n, width) for n in lengths):
        norm = lambda x: f"sqrt(aggregate(slice({x}, 1, {n}), 0e0, (s, y) -> s + y * y))"  # noqa: B023, E731
        own = norm("__near" if side == "v" else c)
        made |= {f"{side}sum{i}": f"aggregate(slice(__levels, 1, {n}), {n / 8!r}D, (s, x) -> s + x * 5e-1)", f"{side}norm{i}": own}
        made[f"{side}left{i}"] = f"{norm('__left')} * (1e0 + 1e-9) + {own} * 1e-12"  # with room for the sums' own rounding
    return out.select(*df.columns, step, *(F.expr(f"{x} AS {name}") for name, x in made.items()))


def _whole(df: DataFrame, side: str) -> DataFrame:
    """`df` with a sketch's columns as ones that have no nulls: a test on them takes a ninth of the time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name.startswith(side) and f.name not in ("vec_id", "qv", "q")}
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in kinds.items()})


def _reached(lengths: list[int], width: int) -> Column:
    """May a pair's product of any length be its query's bar of this length (bar0, ..), or over it?  The product of what levels stand for is
    made of bits that both have; Cauchy and Schwarz bound the rest."""
    bits, any_ = _sketch_bits(lengths, width), []
    for i, n in enumerate(min(n, width) for n in lengths):
        terms = [f"vsum{i}", f"qsum{i}"]
        for w in (w for w, (_, to) in enumerate(_words(lengths, width)) if to <= n):
            # The last bit of a level below zero counts against it.
            terms += [f"bit_count(v{w}_{x} & q{w}_{y}) * {'-' if (x == bits - 1) != (y == bits - 1) else ''}{1 << (x + y)}e0" for x in range(bits) for y in range(bits)]
        any_.append(f"vstep * qstep * ({' + '.join(terms)}) + vnorm{i} * qleft{i} + vleft{i} * qnorm{i} >= bar{i}")
    return F.expr(" OR ".join(any_))


def _parted(df: DataFrame, c: str, width: int) -> tuple[DataFrame, DataFrame | None]:
    """`df` with arrays of doubles, and, if there are such, the rows whose arrays are null, have another length than `width`,
    or hold nulls or what is not finite."""
    most = F.greatest(F.array_max(c), -F.array_min(c))  # NaN is above all
    plain = F.coalesce((F.size(c) == width) & ~F.exists(c, lambda x: x.isNull()) & (most < 1e100), F.lit(False)) if width > 0 else F.lit(False)
    odd = df.where(~plain)
    doubles = F.coalesce(F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array().cast("array<double>"))
    return df.where(plain).withColumn(c, doubles), odd if odd.limit(1).count() else None


def _width(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("embedding"))).first()[0] or 0


def _products(vectors: DataFrame, queries: DataFrame, lengths: list[int], max_queries: int) -> DataFrame:
    """The pairs of `_met` with s0, s1, ..: the products of the first dimensions.  Odd arrays meet the others in the fold."""
    width = _width(vectors)
    (even, odd), (asked, odd_asked) = _parted(vectors, "embedding", width), _parted(queries, "qv", width)
    out = _stepped(_met(even, asked, max_queries), lengths, width) if width > 0 else _folded(_met(even, asked, max_queries), lengths)
    for v, q in ((odd, queries), (even if odd_asked is not None else None, odd_asked)):
        if v is not None:
            out = out.unionByName(_folded(_met(v, q, max_queries), lengths))
    return out


def inner_products(vectors: DataFrame, queries: DataFrame, max_queries: int = 4096) -> DataFrame:
    """(q, vec_id, score) of every query and other vector."""
    return _products(vectors.select("vec_id", "embedding"), queries.select("q", "qv"), [1 << 30], max_queries).select("q", "vec_id", F.round("s0", 9).alias("score"))


def prefix_products(vectors: DataFrame, queries: DataFrame, lengths: list[int], max_queries: int = 4096) -> DataFrame:
    """(q, vec_id, products): for each of the lengths, in rising order, (n, s), the product of the first n dimensions: each
    goes on from the one before."""
    got = _products(vectors.select("vec_id", "embedding"), queries.select("q", "qv"), lengths, max_queries)
    return got.select("q", "vec_id", F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"s{i}").alias("s")) for i, n in enumerate(lengths))).alias("products"))


def _block_hits(vectors: DataFrame, queries: DataFrame, k: int, lengths: list[int], width: int, max_queries: int) -> DataFrame:
    """(q, n, vec_id, s): of each part of the vectors what may be among each other query's k best, for each of the lengths n; arrays
    are of `width` finite doubles.  Parts meet blocks of queries, so no task has more than one of each."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-queries.count() // max(1, max_queries)))
    parts = max(1, -(-vectors.count() // PART_ROWS), -(-2 * cores // blocks))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding", place("vec_id", parts).alias("part"), every(blocks).alias("block"))
    asked = queries.where("q IS NOT NULL").select("q", "qv", place("q", blocks).alias("block"), every(parts).alias("part"))
    kinds = [StructField("q", queries.schema["q"].dataType), StructField("n", IntegerType()), StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("s", DoubleType())]
    by = ["block", "part"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_multiplier(k, lengths, width), StructType(kinds))


def _multiplier(k: int, lengths: list[int], width: int):
    def work(vectors, queries):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, asked = vectors["vec_id"].combine_chunks(), queries["q"].combine_chunks()
        v, q = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for t, c in ((vectors, "embedding"), (queries, "qv")))

        def kth(i, x, n):
            """For each row the k-th of its query's x, which are in falling order; of fewer none."""
            of, bar = np.bincount(i, minlength=n), np.full(n, -np.inf)
            bar[of >= k] = x[(np.cumsum(of) - of)[of >= k] + k - 1]
            return bar[i]

        ends = [min(n, width) for n in lengths]
        made = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        place = np.empty(len(v), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(v))
        key, mine = ids.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
        own = np.flatnonzero(np.isin(key, mine)) if len(v) else place
        # What a product of matrices may differ from one added in the order of the dimensions, and from its rounding.
        room = 1e-8 + 4 * width * np.finfo(float).eps * np.sqrt((q * q).sum(1)) * (np.sqrt((v * v).sum(1).max()) if len(v) else 0)
        for at in range(0, len(q) if len(v) else 0, SLICE):
            some, gap = q[at : at + SLICE], room[at : at + SLICE]
            s = np.zeros((len(some), len(v)))
            for begin, end, n in zip([0, *ends], ends, lengths):
                s += some[:, begin:end] @ v[:, begin:end].T
                if not begin:
                    i, j = np.nonzero(mine[at : at + SLICE][:, None] == key[own][None, :])
                    s[i, own[j]] = -np.inf  # a query's own row
                head = s[:, :HEAD]
                bar = np.partition(head, head.shape[1] - k, 1)[:, head.shape[1] - k] if head.shape[1] > k else np.full(len(some), -np.inf)
                i, j = np.nonzero(s >= np.maximum(bar - gap, np.finfo(float).min)[:, None])
                by = np.lexsort((-s[i, j], i))
                i, j = i[by], j[by]
                near = s[i, j] >= kth(i, s[i, j], len(some)) - gap[i]
                i, j = i[near], j[near]
                exact = np.zeros(len(i))
                for d in range(end):
                    exact += v[j, d] * some[i, d]
                # Of equal products the first k ids': copies are not all handed on.
                by = np.lexsort((place[j], -exact, i))
                i, j, exact = i[by], j[by], exact[by]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
                here = np.arange(len(i))
                few = (here - np.maximum.accumulate(np.where(new, here, 0)) < k) & (exact >= kth(i, exact, len(some)) - 1e-8)
                for to, x in zip(made, (i[few] + at, np.full(int(few.sum()), n, np.int32), j[few], exact[few])):
                    to.append(x)
        i, n, j, exact = map(np.concatenate, made)
        return pa.table({"q": asked.take(pa.array(i)), "n": pa.array(n), "vec_id": ids.take(pa.array(j)), "s": pa.array(exact)})

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int, lengths: list[int] | None = None, by: str | None = None, max_queries: int = 4096) -> DataFrame:
    """(q, n, vec_id, score, rank): the k rows of largest product with each query, for each of the lengths n.

    Many pairs are multiplied as matrices, a part of the vectors with a block of queries in a task, which hands on each query's best.
    With `by`, and of fewer pairs, all meet, but few are sorted, and of many few are multiplied: the k-th best of a sample is no better
    than the k-th best of all, so what stays under it, as the sketches tell or the product does, goes at once.  The sample's own
    k best are found in the same way, by one of a sixteenth of its rows."""
    ends, keys = lengths or [1 << 30], [by] if by else []
    vectors, queries = vectors.select("vec_id", "embedding", *keys), queries.select("q", "qv", *keys)
    width, cores, rows, share = _width(vectors), vectors.sparkSession.sparkContext.defaultParallelism, vectors.count(), 1
    many = width > 0 and rows * queries.count() > SKETCH_PAIRS
    if many and not by:
        return _of_blocks(vectors, queries, k, ends, width, max_queries)
    while rows // share > SAMPLE_ROWS:
        share *= SAMPLE_STEP
    sketch = share > 1 and many and _sketch_bits(ends[:1], width) > 1
    if sketch and len(ends) > 1:
        # A comparison for several lengths at once is a function that the JVM doesn't compile.
        cut = lambda df, c, n: df.withColumn(c, F.slice(c, 1, n))
        parts = [nearest(cut(vectors, "embedding", n), cut(queries, "qv", n), k, [n], by, max_queries) for n in ends]
        return reduce(DataFrame.unionByName, parts)
    # Tables may be one file of one row group, which is one task's: they are dealt first, and what each round reads is made once.
    (even, odd), (asked, odd_asked) = _parted(vectors.repartition(cores), "embedding", width), _parted(queries.repartition(cores), "qv", width)
    if sketch:
        even, asked = stored(_sketched(even, "embedding", ends, width, "v"), "sketches"), stored(_sketched(asked, "qv", ends, width, "q"), "sketches")
    plain = [c for c in ("vec_id", "embedding", "q", "qv", *keys)]
    least = None

    def barred(df):
        """Queries with least0, .., the best's bars, and bar0, .., which leave room for the rounding of what was ranked."""
        df = df.join(F.broadcast(least), "q", "left") if least is not None else df.select("*", *(F.lit(None).cast("double").alias(f"least{i}") for i in range(len(ends))))
        return df.withColumns({f"bar{i}": F.coalesce(F.col(f"least{i}") - 1e-8, F.lit(float("-inf"))) for i in range(len(ends))})

    while True:
        some = lambda df: df.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0) if share > 1 else df  # noqa: B023, E731
        told = [f"least{i}" for i in range(len(ends))]
        if sketch and least is not None:
            met = _met(_whole(some(even), "v"), barred(_whole(asked, "q")), max_queries, by).where(_reached(ends, width))
        else:
            met = _met(some(even.select(*(c for c in even.columns if c in plain))), barred(asked.select(*(c for c in asked.columns if c in plain))), max_queries, by)
        met = met.select(*plain, *told)
        scored = _stepped(met, ends, width) if width > 0 else _folded(met, ends)
        for v, q in ((odd, queries), (even.select("vec_id", "embedding", *keys) if odd_asked is not None else None, odd_asked)):
            if v is not None:
                scored = scored.unionByName(_folded(_met(some(v), barred(q), max_queries, by).select(*plain, *told), ends))
        # Products are compared as they are first, with room for the rounding, which takes longer than they do.
        over = [F.coalesce(F.col(f"s{i}") >= F.col(f"least{i}") - 1e-8, F.col(f"least{i}").isNull()) for i in range(len(ends))]
        any_ = over[0]
        for x in over[1:]:
            any_ = any_ | x
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"s{i}").alias("s"), x.alias("over")) for i, (n, x) in enumerate(zip(ends, over)))))
        kept = scored.where(any_).select("q", "vec_id", each.alias("x")).where("x.over").select("q", "x.n", "vec_id", F.round("x.s", 9).alias("score"))
        found = hits(kept, k, ("q", "n"))
        if share == 1:
            return found
        last = found.where(F.col("rank") == k)
        made = last.groupBy("q").agg(*(F.max(F.when(F.col("n") == n, F.col("score"))).alias(f"least{i}") for i, n in enumerate(ends)))
        least = stored(made, "bars") if sketch else made  # a later round doesn't make the earlier ones again
        share //= SAMPLE_STEP


def _of_blocks(vectors: DataFrame, queries: DataFrame, k: int, ends: list[int], width: int, max_queries: int) -> DataFrame:
    """`nearest` by products of blocks.  Odd arrays meet the others in the fold, under the bars that the blocks' hits give."""
    (even, odd), (asked, odd_asked) = _parted(vectors, "embedding", width), _parted(queries, "qv", width)
    kept = _block_hits(even, asked, k, ends, width, max_queries).select("q", "n", "vec_id", F.round("s", 9).alias("score"))
    found = hits(kept, k, ("q", "n"))
    if odd is None and odd_asked is None:
        return found
    found = stored(found, "hits")
    least, all_ = found.where(F.col("rank") == k).select("q", "n", F.col("score").alias("least")), found.drop("rank")
    for v, q in ((odd, queries), (even if odd_asked is not None else None, odd_asked)):
        if v is not None:
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"s{i}").alias("s")) for i, n in enumerate(ends))))
            met = _folded(_met(v, q, max_queries), ends).select("q", "vec_id", each.alias("x")).select("q", "x.n", "vec_id", F.round("x.s", 9).alias("score"))
            over = met.join(F.broadcast(least), ["q", "n"], "left").where("least IS NULL OR score >= least")
            all_ = all_.unionByName(over.drop("least"))
    return hits(all_, k, ("q", "n"))


def hits(scored: DataFrame, n: int, by=("q",)) -> DataFrame:
    """The n best of each query with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_chunks(found: DataFrame) -> DataFrame:
    """Adds the page (eight crops each), the crop and its scale: crop 0 is the whole page's."""
    crop = F.pmod("vec_id", F.lit(8)).cast("int")
    return found.withColumn("page", F.floor(F.col("vec_id") / 8)).withColumn("chunk", crop).withColumn("scale", F.when(crop == 0, "page").otherwise("region"))


def page_scores(found: DataFrame, by=("q",), agreement: float = AGREEMENT, gist: float = GIST_BONUS) -> DataFrame:
    """(by.., page, score, n_chunks, focus, first): best weighted crop plus a share of the others;
    focus is the best crop that isn't a whole page, first the page's place in the hit list."""
    w = F.col("score") * F.when(F.col("scale") == "page", gist).otherwise(1.0)
    order = F.struct((-w).alias("w"), F.col("rank").alias("r"), F.col("chunk").alias("c"))
    best = F.max(w)
    return found.groupBy(*by, "page").agg(
        F.round(best + agreement * (F.sum(w) - best), 9).alias("score"),
        F.count("*").alias("n_chunks"),
        F.min(F.when(F.col("scale") != "page", order))["c"].alias("focus"),
        F.min("rank").alias("first"),
    )


def fuse(pages: DataFrame, by=("q",)) -> DataFrame:
    """One list of several variants' (column variant): scores over the variant's best, the larger
    stays, ties go to the earlier variant."""
    most = F.max("score").over(Window.partitionBy(*by, "variant"))
    norm = F.col("score") / F.when(F.coalesce(most, F.lit(0.0)) == 0, 1.0).otherwise(most)
    pick = Window.partitionBy(*by, "page").orderBy(F.desc("norm"), "variant")
    one = pages.withColumn("norm", norm).withColumn("pick", F.row_number().over(pick)).where("pick = 1").drop("pick")
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("norm", 9)), "variant", "first", "page")
    return one.withColumn("rank", F.row_number().over(order))


def rrf(lists: DataFrame, by=("q",), k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (columns list, weight, page, rank): the lower list
    number's record stays, ties keep first-seen order."""
    first = F.min(F.struct("list", "rank"))
    out = lists.groupBy(*by, "page").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"), first.alias("seen"))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf"), "seen", "page")
    return out.withColumn("rank", F.row_number().over(order))
