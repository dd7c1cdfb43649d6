"""Nearest neighbours by inner product: probed lists, scanned by an adaptive number of dimensions.

Fit: spherical k-means on a bounded sample (rows of smallest hash: an eighth of the rows, `SAMPLE` of them, or more
where there are more lists, but never over `MOST`) gives the lists' centres; there are about sqrt(rows) / 4
lists, and one random rotation is drawn.  Every row is then put in its nearest centre's list, and
lists are cut into blocks, so a hot list is many blocks.

Search: a query probes its nearest lists.  In a block, the rotated vectors are read in column
blocks.  After d of D dimensions a hypothesis test abandons candidates.  Were the whole inner product
c |q| |x|, a random rotation would make the partial one about normal, with mean d/D of it and variance
(1 + c^2) d (D - d) / (D^2 (D + 2)) |q|^2 |x|^2; where it is Z deviations under what the query's bar
would give, the candidate goes.  The bar is the query's K-th best in the sample, so it never exceeds
the true one.  Survivors get their exact score in double precision on the original vectors, summed
from the first component to the last.  The sample's K best are found too, so K are always returned.

The number of probed lists is found on the sample: the smallest that holds `COVER` of the true
neighbours of sample rows.  It so follows the data; on vectors without any clusters it is most lists.

Defined results: vectors that are null, zero, of another length than the commonest (the shorter of two
as common), or hold null or non-finite components take no part, as queries or candidates; rows that
repeat an id and its vector are made one before anything else, and no row is a candidate for a query of its
id; an id with several vectors is in a result once, with its best score; ties go to the smaller id; fewer candidates than K: all that are found; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, table

K = 20
EVERY = 20
#: Rows that the lists, the bar and the number of probes are fitted on (64-d: 2 MB; 32 MB at most).
SAMPLE, MOST = 4096, 1 << 16
#: Share of the sample rows' true neighbours that the probed lists have to hold.
COVER = 0.98
Z = 3.0
#: Share of candidates under which the rest is read pair by pair.
SPARSE = 0.15
COLUMNS = 16
#: Rows of one block of candidates and of one block of queries.
BLOCK, QUERIES = 4096, 2048
#: A list has that many rows of the sample on average.
SAMPLE_OF_LIST = 8


def _kmeans(x, n: int, rounds: int = 12, seed: int = 7):
    import numpy as np

    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit[rng.choice(len(unit), n, replace=False)].copy()
    for _ in range(rounds):
        near = (unit @ c.T).argmax(1)
        for j in range(n):
            own = unit[near == j]
            if len(own):
                s = own.sum(0)
                c[j] = s / (np.linalg.norm(s) or 1)
    return c


def lists_of(n_rows: int) -> int:
    return round(math.sqrt(n_rows) / 4)


def sample_of(n_rows: int, k: int = K) -> int:
    return min(MOST, n_rows, max(4 * k, min(SAMPLE, n_rows // 8), SAMPLE_OF_LIST * lists_of(n_rows)))


class Fit:
    """What a bounded sample teaches: centres, rotation, number of probes; small enough to ship."""

    def __init__(self, ids, x, n_rows: int, k: int = K, cover: float = COVER, seed: int = 7):
        import numpy as np

        self.ids, self.x, self.k = ids, x, k
        d = x.shape[1]
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        self.rotation = q * np.sign(np.diag(r))
        n = max(1, min(len(x) // SAMPLE_OF_LIST, lists_of(n_rows)))
        self.centres = _kmeans(x, n, seed=seed)
        self.probes = self._probes(cover)

    def _probes(self, cover: float) -> int:
        import numpy as np

        n = len(self.centres)
        if len(self.x) <= self.k + 1:
            return n
        ask = np.arange(0, len(self.x), max(1, len(self.x) // 256))
        scores = self.x[ask] @ self.x.T
        scores[np.arange(len(ask)), ask] = -np.inf
        best = np.argpartition(-scores, self.k, axis=1)[:, : self.k]
        home = self.home(self.x)
        rank = np.empty((len(ask), n), int)
        order = np.argsort(-(self.x[ask] @ self.centres.T), axis=1, kind="stable")
        np.put_along_axis(rank, order, np.arange(n)[None, :].repeat(len(ask), 0), axis=1)
        at = np.take_along_axis(rank, home[best], axis=1).ravel()
        return int(min(n, np.quantile(at, cover, method="higher") + 1))

    def home(self, x):
        return (x @ self.centres.T).argmax(1)

    def known(self, ids, q):
        """(bar, positions in the sample, scores) of the k best of the sample for each query."""
        import numpy as np

        s = q @ self.x.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        k = min(self.k, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(s, at, axis=1)
        bar = best.min(1) if k == self.k else np.full(len(q), -np.inf)
        exact = exact_scores(self.x[at.ravel()], np.repeat(q, k, axis=0)).reshape(at.shape)
        return bar, at, np.where(np.isfinite(best), exact, -np.inf)


def exact_scores(x, q):
    """Inner products of paired rows, from the first component to the last, in double precision."""
    import numpy as np

    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


def scan_block(xi, x, qi, q, bars, rotation, k: int, z: float = Z, columns: int = COLUMNS, at_once: int = 256):
    """(query position, candidate position, score) of each query's k best in a block, of those that
    reach its bar."""
    import numpy as np

    rx, rq = x @ rotation, q @ rotation
    d = x.shape[1]
    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    cos = np.clip(np.nan_to_num(bars / (nq * nx.min()), neginf=0.0), 0, 1)
    wide = z * np.sqrt(1 + cos * cos) * nq
    slack = 1e-9 * (1 + nq * nx.max())
    edges = [*range(columns, d, columns), d]

    def least(m, rows):
        """(of each query, and times |x|): what a partial product of m dimensions has to reach."""
        return m / d * bars[rows] - slack[rows], wide[rows] * math.sqrt(m * (d - m) / (d * d * (d + 2)))

    found = []
    for lo in range(0, len(q), at_once):
        rows = np.arange(lo, min(lo + at_once, len(q)))
        part = alive = pairs = None
        for m, before in zip(edges, [0, *edges]):
            base, dev = least(m, rows)
            if pairs is None:  # many are left: all pairs of the block at once
                step = rq[rows, before:m] @ rx[:, before:m].T
                part = step if part is None else part + step
                fit = part >= base[:, None] - dev[:, None] * nx[None, :]
                alive = fit if alive is None else alive & fit
                if m < d and alive.mean() < SPARSE:
                    a, b = np.nonzero(alive)
                    pairs = a, b, part[a, b]
            else:
                a, b, s = pairs
                s = s + np.einsum("ij,ij->i", rq[rows[a], before:m], rx[b, before:m])
                fit = s >= base[a] - dev[a] * nx[b]
                pairs = a[fit], b[fit], s[fit]
        a, b = pairs[:2] if pairs is not None else np.nonzero(alive)
        found.append((rows[a], b))
    a, b = (np.concatenate(c) for c in zip(*found))
    other = xi[b] != qi[a]
    a, b = a[other], b[other]
    s = exact_scores(x[b], q[a])
    order = np.lexsort((xi[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[top], b[top], s[top]


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & ok)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", cover: float = COVER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id `every` divides."""
    import numpy as np

    spark = vectors.sparkSession
    ship(spark)
    result = "query_id long, rank int, vec_id long, score double"
    # Each id and vector once from here on: repeats would fill blocks' K places and raise the bar.
    valid = stored(_valid(vectors, key, vector).distinct(), "ann-rows")
    usual = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not usual:
        return spark.createDataFrame([], result)
    d, n_rows = usual
    valid = valid.where(F.size("v") == d)
    # About 1.3 times as many rows pass the hash filter, however many rows or tasks there are.
    sample = sample_of(n_rows, k)
    low = F.shiftrightunsigned(F.xxhash64("id", "v"), 11) < F.lit(int(min(1.0, 1.3 * sample / n_rows) * (1 << 53)))
    got = valid.where(low | F.lit(n_rows <= 4 * sample)).orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()
    fit = spark.sparkContext.broadcast(Fit(np.array([r["id"] for r in got]), np.array([r["v"] for r in got]), n_rows, k, cover))

    def matrix(column):
        return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, d)

    def place(batches):
        import pyarrow as pa

        f = fit.value
        for b in batches:
            if b.num_rows:
                home = f.home(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32))], names=["id", "v", "list"])

    def probe(batches):
        import pyarrow as pa

        f = fit.value
        for b in batches:
            if b.num_rows:
                q, ids = matrix(b.column(1)), b.column(0).to_numpy()
                order = np.argsort(-(q @ f.centres.T), axis=1, kind="stable")[:, : f.probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), order.ravel())
                bar, at, score = f.known(ids, q)
                ends = np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)
                near, far = (pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (f.ids[at], score))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bar), lists, near, far], names=["id", "v", "bar", "lists", "near", "near_score"])

    placed = stored(valid.mapInArrow(place, "id long, v array<double>, list int"), "ann-lists")
    asked = stored(valid.where(F.col("id") % every == 0).mapInArrow(probe, "id long, v array<double>, bar double, lists array<int>, near array<long>, near_score array<double>"), "ann-queries")
    n_queries = asked.count()
    # Blocks: one row for each list (at most MAX_LISTS) says into how many parts it is cut.
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sides = max(1, math.ceil(n_queries * fit.value.probes / len(fit.value.centres) / QUERIES))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    rows = (
        placed.join(F.broadcast(parts), "list")
        .withColumn("part", part(F.col("parts")))
        .withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
        .select("list", "part", "side", F.lit(0).alias("q"), "id", "v", F.lit(None).cast("double").alias("bar"))
    )
    queries = (
        asked.withColumn("side", part(F.lit(sides)))
        .withColumn("list", F.explode("lists"))
        .join(F.broadcast(parts), "list")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("list", "part", "side", F.lit(1).alias("q"), "id", "v", "bar")
    )

    def scan(group):
        import pyarrow as pa

        g = group.combine_chunks()
        is_q = g["q"].to_numpy() == 1
        ids, v = g["id"].to_numpy(), matrix(g["v"].combine_chunks() if not isinstance(g["v"], pa.ChunkedArray) else pa.concat_arrays(g["v"].chunks))
        f = fit.value
        qi, q, bars = ids[is_q], v[is_q], g["bar"].to_numpy()[is_q]
        xi, x = ids[~is_q], v[~is_q]
        if not len(qi) or not len(xi):
            a = b = np.zeros(0, int)
            s = np.zeros(0)
        else:
            a, b, s = scan_block(xi, x, qi, q, bars, f.rotation, k)
        return pa.table({"query_id": qi[a], "vec_id": xi[b], "score": s})

    found = rows.unionByName(queries).groupBy("list", "part", "side").applyInArrow(scan, "query_id long, vec_id long, score double")
    known = asked.select("id", F.explode(F.arrays_zip("near", "near_score")).alias("n")).select(F.col("id").alias("query_id"), F.col("n.near").alias("vec_id"), F.col("n.near_score").alias("score"))
    found = found.unionByName(known.where(F.col("score") > float("-inf"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
