"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, classes.

A fingerprint's bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's
word shingles.  Documents with one fingerprint are one class, so the search runs over distinct
fingerprints.  64 bits are cut into `BLOCKS` blocks; two fingerprints with at most `DISTANCE`
bits apart agree on BLOCKS - DISTANCE whole blocks at least, so they meet in one of the tables
that are keyed by such a choice of blocks.  In a bucket of a table, Hamming distances are compared
and a spanning forest of the links is kept (never all pairs).

A bucket of more than `BUCKET` fingerprints is searched another, exact way, whose rows grow with
the bucket and not with its square: two fingerprints at most 2r bits apart share a point at most r
bits from each, so all points up to r bits around each fingerprint are made, and those that share
a point are linked through it (they are at most 2r apart).  For an odd distance the pairs at one
bit more are not certain, so `DISTANCE` has to be even for this way.

`classes(similar=True)` also links texts whose sets of five-word shingles have a Jaccard similarity of
`SIMILAR` or more.  Such texts' 64 bits differ in 4 to 14 places, too many for pigeonhole blocks, so
their blocks are others: `BANDS` keys, each of `BAND_ROWS` min-wise hashes of the shingles, of which
similar texts share one at least (99.5% of pairs at 0.8).  Members of a block within `WIDE_DISTANCE` bits
of 256-bit SimHashes are candidates; the shingle sets themselves, made of the texts again, decide.  In
`ROUNDS` rounds two members of each block are compared with all others and classes are made.  Among the
members of blocks that then still hold several classes, whatever similar pairs are left is found by prefixes of their sets: with
shingles in order of how few of these members have them, two sets of `SIMILAR` or more share one among the first n - ceil(0.8 n) + 1
of each, and each can be reached by what the other has behind it.  A set that by a shingle doesn't reach its own size is
similar by it to longer-reaching ones only, so texts of one template that are not similar, however many, meet
nobody; and where sets could meet in numbers, the smallest that reaches its size is first compared with all others of its shingle,
which makes the similar ones one class, and members of one class are not compared.  Joins spread hot keys over several tasks.

Classes are the connected components: stars are contracted (each fingerprint to its smallest
neighbour) in rounds, each written to the shared folder.

Defined results: null and wordless texts have fingerprint 0 and are linked as any other; fewer
words than a shingle are one shingle; repeated rows and repeated ids have a row each; null ids
come behind all others, so a class of null ids alone has a null component; an
empty table gives an empty result; other columns of the input are ignored; texts are read whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import ASCII_LOWER, discard, fresh, give_back, if_few, ship, spread_join, stored, table

WORDS, DISTANCE, BLOCKS, BUCKET = 4, 4, 7, 2048
#: The other way's shingles, least similarity, blocks, and bits apart of its 256 that candidates have
#: at most (0.8 similar: 39 expected, deviation 6; so this is a filter 6 deviations wide).
SIMILAR_WORDS, SIMILAR, BANDS, BAND_ROWS, WIDE_DISTANCE = 5, 0.8, 28, 8, 76
#: Rounds in which two members of each block are compared with its others, before what is left is.
ROUNDS = 2
#: Rounds at most in which a shingle's smallest set is compared with all others of it, where on the average over so many could meet each.
CENTRES, CROWDED = 3, 4
#: Texts of more words are hashed in pieces of so many shingles, to bound memory.
PIECE = 1 << 16


def _bits(text: bytes | None, width: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        some = words[a : a + PIECE + width - 1]
        m = min(PIECE, n - a)
        got = np.fromiter((h(s, 42) for s in map(b" ".join, zip(*(some[i:] for i in range(width))))), np.uint64, m) if len(words) >= width else np.array([h(b" ".join(words), 42)], np.uint64)
        ones += np.unpackbits(got.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _mixed(x, seed: int):
    """A bijective mix of 64-bit values, another one for each seed."""
    import numpy as np

    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _shingles(text: bytes | None, width: int = SIMILAR_WORDS):
    """The different hashes of a text's shingles, all of them."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = text.translate(ASCII_LOWER).split() if text else []
    width = min(width, len(words))
    got = np.zeros(0, np.uint64)
    for a in range(0, len(words) - width + 1 if words else 0, PIECE):
        some = words[a : a + PIECE + width - 1]
        got = np.union1d(got, np.fromiter((h(s, 42) for s in map(b" ".join, zip(*(some[i:] for i in range(width))))), np.uint64))
    return got


def _sketch(text: bytes | None, width: int = SIMILAR_WORDS) -> tuple[list[int], list[int]]:
    """(256-bit SimHash as four signed longs, block keys) of a text's set of shingles; both are
    empty without a word.  Repeats in one piece of `PIECE` shingles count once."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return [], []
    width = min(width, len(words))
    n, total = len(words) - width + 1, 0
    ones, least = np.zeros(256, np.int64), np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    times = _mixed(np.arange(BANDS * BAND_ROWS, dtype=np.uint64), 7) | np.uint64(1)
    for a in range(0, n, PIECE):
        some = words[a : a + PIECE + width - 1]
        got = np.unique(np.fromiter((h(s, 42) for s in map(b" ".join, zip(*(some[i:] for i in range(width))))), np.uint64))
        total += len(got)
        wide = np.stack([_mixed(got, k) for k in range(4)], axis=1)
        ones += np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(-1, 32), axis=1).sum(0, dtype=np.int64)
        for b in range(0, len(got), 1024):
            least = np.minimum(least, (got[b : b + 1024, None] * times).min(0))
    bits = np.packbits(ones * 2 > total).view(">u8").astype(np.uint64).view(np.int64).tolist()
    keys = [h(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return bits, np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = WORDS, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """(key, h, fp) of every row; fp is the fingerprint as a signed long, h a hash of the whole text.
    With `similar` also wide and bands, what `_sketch` gives."""
    ship(docs.sparkSession)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([_bits(t, width) for t in texts], np.uint64).view(np.int64)
            out = [b.column(0), b.column(2), pa.array(fp)]
            if similar:
                out += [pa.array(list(x), pa.list_(pa.int64())) for x in zip(*map(_sketch, texts))] or [pa.array([], pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays(out, names=names)
        texts = b = out = None
        give_back()

    kinds = {key: docs.schema[key].dataType, "h": LongType(), "fp": LongType()} | ({"wide": ArrayType(LongType()), "bands": ArrayType(LongType())} if similar else {})
    names, schema = list(kinds), StructType([StructField(n, t) for n, t in kinds.items()])
    return docs.select(F.col(key), F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("h")).mapInArrow(work, schema)


def _masks(blocks: int, distance: int) -> list[int]:
    """A signed mask for each choice of blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(part, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values, distance: int):
    """Links (smaller position, larger position) that connect what pairs within `distance` bits connect."""
    import numpy as np

    v = np.asarray(values).view(np.uint64) if len(values) else np.zeros(0, np.uint64)
    n = len(v)
    left = np.arange(n)
    links = []
    # Breadth first: each value is compared once with those not reached yet.
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(v[left] ^ v[at]) <= distance
            if near.any():
                got = left[near]
                links += [(at, g) for g in got]
                queue += got.tolist()
                left = left[~near]
    return links


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column fp) that connect all that pairs
    within `distance` bits connect."""
    if distance % 2:
        raise ValueError("an even distance is needed")
    masks = _masks(blocks, distance)
    keyed = fps.select("fp", F.posexplode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("table", "block"))
    size = keyed.groupBy("table", "block").agg(F.count("*").alias("n"))
    size = stored(size.where("n > 1"), "simhash-buckets")
    small = keyed.join(size.where(F.col("n") <= bucket), ["table", "block"]).groupBy("table", "block").agg(F.collect_list("fp").alias("fps"))

    def inside(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = set()
            for x in b.column(0):
                v = np.sort(x.values.to_numpy())
                found.update((int(v[i]), int(v[j])) for i, j in forest(v, distance))
            found = sorted((min(p), max(p)) for p in found)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = small.select("fps").mapInArrow(inside, "a long, b long")
    big = size.where(F.col("n") > bucket)
    if big.limit(1).count():
        hot = keyed.join(big, ["table", "block"], "left_semi").select("fp").distinct()
        bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
        around = [0]
        for r in range(1, distance // 2 + 1):
            for c in itertools.combinations(bits, r):
                x = 0
                for y in c:
                    x ^= y
                around.append(x)
        ball = F.transform(F.lit(around), lambda m: F.col("fp").bitwiseXOR(m))
        points = hot.select("fp", F.explode(ball).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
        star = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
        links = links.unionByName(star)
    return links.distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(h, shingles): the set of hashes of the five-word shingles of each of (h, t)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sets = [np.sort(_shingles(t)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])
        sets = b = None
        give_back()

    return texts.select("h", "t").mapInArrow(work, StructType([StructField("h", LongType()), StructField("shingles", ArrayType(LongType()))]))


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those of `pairs` (h, other, ...) whose shingle sets have a Jaccard similarity of `least` or more."""
    x, y = (sets.select(F.col("h").alias(k), F.col("shingles").alias(f"of_{k}"), F.size("shingles").alias(f"n_{k}")) for k in ("h", "other"))
    near = pairs.join(x, "h").join(y, "other").where(F.least("n_h", "n_other") >= least * F.greatest("n_h", "n_other") - 1e-6)
    both = F.size(F.array_intersect("of_h", "of_other"))
    return near.where(both / (F.col("n_h") + F.col("n_other") - both) >= least).select(*pairs.columns)


def prefix_keys(rows: DataFrame, sets: DataFrame, wide: list[str], least: float = SIMILAR) -> DataFrame:
    """(s, h, fp, size, rest, reach, `wide`): the shingles of the prefixes of `rows` (h, fp, root, `wide`) that members of several classes
    have; `rest` shingles at most, from s on, are shared by two sets that share none before, and `reach` is the
    largest size that a set can have which is similar to this one by them."""
    rows = stored(rows.dropDuplicates(["h"]).join(sets, "h").withColumn("size", F.size("shingles")), "similar-members")
    each = rows.select("h", "root", "size", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("of"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("of > 1")
    met = spread_join(each, often, ["s"], ["h"], rows.agg(F.sum("size")).first()[0] or 0)
    met = met.groupBy("h", "size").agg(F.array_sort(F.collect_list(F.struct("of", "s", (F.col("low") < F.col("high")).alias("mixed")))).alias("known"))
    # A set's shingles that no other has come first in its prefix, and meet nothing.
    prefix = F.floor((1 - least) * F.col("size") + 1e-6) + 1
    left = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("known"))).cast("int")
    keys = met.select("h", F.size("known").alias("known_n"), F.posexplode(F.slice("known", F.lit(1), left)).alias("at", "x")).where("x.mixed")
    keys = keys.select("h", F.col("x.s").alias("s"), (F.col("known_n") - F.col("at")).alias("rest"))
    reach = F.col("rest") * (1 + least) / least - F.col("size") + 1e-6
    keyed = keys.join(rows.select("h", "fp", "size", *wide), "h").select("s", "h", "fp", "size", "rest", reach.alias("reach"), *wide)
    keyed = stored(keyed, "similar-prefixes")
    discard(rows)
    return keyed


def prefix_links(keyed: DataFrame, roots: DataFrame, sets: DataFrame, wide: list[str], distance: int, found: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b): links that with `found`, of classes `roots`, connect what similar sets of `keyed` (see `prefix_keys`) do.

    Two sets are similar by a shared shingle only if each is within the other's reach.  One that doesn't reach its own size
    can't be similar to another such, so pairs need one that does: texts of one template that are not similar make none.
    Where many could meet, the smallest set that reaches its size is first compared with all others of its
    shingle, in rounds; what is then of one class is not compared.  Last, classes that a shingle has in common meet, if
    their members can."""
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o.{w}"))) for w in wide), F.lit(0))
    within = (F.col("size") <= F.col("o.reach")) & (F.col("o.size") <= F.col("reach"))
    mine, total = ["h", "fp", "root", "size", "reach", *wide], keyed.count()
    long_ = F.col("reach") >= F.col("size")
    links = None

    def of_classes():
        named = keyed.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = named.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_if(long_).alias("longs"), F.count("*").alias("members")).where("low < high AND longs > 0")
        return stored(named.join(several.select("s"), "s", "left_semi"), "similar-left"), several.agg(F.sum(F.col("longs") * F.col("members")), F.sum("members")).first()

    def kept(met):
        pairs = met.where((F.col("root") != F.col("o.root")) & within & (apart <= distance)).select(F.least("fp", "o.fp").alias("a"), F.greatest("fp", "o.fp").alias("b"), F.least("h", "o.h").alias("h"), F.greatest("h", "o.h").alias("other")).distinct()
        pairs = stored(pairs, "similar-prefix-pairs")
        out = stored(confirmed(pairs, sets).select("a", "b").distinct(), "similar-links")
        discard(pairs)
        return out

    left, (could, members) = of_classes()
    for _ in range(CENTRES):
        if not could or could <= CROWDED * members:
            break
        centre = F.min(F.when(long_, F.struct("size", "h", "fp", "root", "reach", *wide))).alias("o")
        centres = left.groupBy("s").agg(centre, F.count("*").alias("n")).where("o IS NOT NULL")
        new = kept(spread_join(left, centres, ["s"], ["h"], total))
        links = new if links is None else links.unionByName(new)
        discard(left)
        roots = components(found.unionByName(links))
        left, (could, members) = of_classes()
    if could:
        side = left.select("s", *mine)
        groups = side.groupBy("s", "root").agg(F.min("size").alias("small"), F.max("reach").alias("far"), F.max(long_).alias("long"))
        other = groups.select("s", *(F.col(c).alias(f"o_{c}") for c in ("root", "small", "far")))
        can = groups.where("long").join(other, "s").where("root <> o_root AND small <= o_far AND o_small <= far").select("s", "root", "o_root")
        ones = side.where(long_).join(can, ["s", "root"])
        both = ones.join(side.select("s", F.col("root").alias("o_root"), F.struct(*mine).alias("o")), ["s", "o_root"])
        new = kept(both.where((F.col("o.reach") < F.col("o.size")) | (F.col("h") < F.col("o.h"))))
        links = new if links is None else links.unionByName(new)
    discard(left)
    return links


def similar_links(rows: DataFrame, linked: DataFrame, texts: DataFrame | None = None, distance: int = WIDE_DISTANCE, rounds: int = ROUNDS) -> DataFrame:
    """(a, b), a < b: links from (fp, h, wide, bands; k with `texts`), by min-wise blocks and wide fingerprints, that
    with those in `linked` connect what all near pairs of members of one block connect.  With `texts`
    (h, k, t) a pair within `distance` is a candidate only, and linked if its shingle sets are similar."""
    wide = [f"w{i}" for i in range(4)]
    own = ["h", "k"] if texts is not None else ["h"]
    keyed = rows.select("fp", *own, *(F.get("wide", F.lit(i)).alias(w) for i, w in enumerate(wide)), F.posexplode("bands").alias("band", "block"))
    blocks = keyed.groupBy("band", "block").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    table_ = keyed = stored(keyed.join(blocks.select("band", "block"), ["band", "block"], "left_semi"), "similar-blocks")
    roots, found, tried, sets = components(linked), linked, None, None
    if texts is not None:
        wanted = if_few(keyed.select(F.col("h").alias("of_h"), F.col("k").alias("of")).distinct())
        some = texts.join(wanted, (F.col("h") == F.col("of_h")) & F.col("k").eqNullSafe(F.col("of")), "left_semi")
        sets = stored(shingle_sets(some).dropDuplicates(["h"]), "similar-sets")
        keyed = keyed.drop("k")
    for r in range(rounds + 1):
        # Blocks whose members are of one class already have nothing to add.
        named = keyed.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = named.groupBy("band", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        rest = stored(named.join(several.select("band", "block"), ["band", "block"], "left_semi"), "similar-rest")
        left = rest.count()
        if not left:
            discard(rest)
            break
        mine = ["root", "h", "fp", *wide]
        if r == rounds and sets is not None:
            prefixes = prefix_keys(rest.select(*mine), sets, wide)
            new = prefix_links(prefixes, roots, sets, wide, distance, found)
            found = found if new is None else found.unionByName(new)
            discard(rest, prefixes)
            break
        if r < rounds:
            # Two members of a block are compared with all others: any one, and one of the last class.
            by = F.xxhash64("h", F.lit(r))
            ends = rest.groupBy("band", "block").agg(F.min(F.struct(by.alias("by"), *mine)).alias("one"), F.max(F.struct("root", by.alias("by"), *mine[1:])).alias("two"), F.count("*").alias("n"))
            other = ends.select("band", "block", "n", F.explode(F.array(*(F.struct(*(F.col(f"{e}.{c}").alias(c) for c in mine)) for e in ("one", "two")))).alias("o"))
            met = spread_join(rest, other, ["band", "block"], ["h"], left)
        else:  # bits alone decide: all pairs of two classes
            met = rest.join(rest.select("band", "block", F.struct(*mine).alias("o")), ["band", "block"])
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o.{w}"))) for w in wide), F.lit(0))
        once = F.lit(True) if r < rounds else F.col("h") < F.col("o.h")
        met = met.where(once & (F.col("root") != F.col("o.root")) & (apart <= distance))
        ends = F.least("fp", "o.fp").alias("a"), F.greatest("fp", "o.fp").alias("b")
        new = met.select(*ends, F.least("h", "o.h").alias("h"), F.greatest("h", "o.h").alias("other")).distinct()
        if sets is not None:
            new = stored(new if tried is None else new.join(tried, ["h", "other"], "left_anti"), "similar-pairs")
            tried = new.select("h", "other") if tried is None else tried.unionByName(new.select("h", "other"))
            new = confirmed(new, sets)
        found = found.unionByName(stored(new.select("a", "b").distinct(), "similar-links"))
        discard(rest)
        if r < rounds:
            roots = components(found)
    all_ = stored(found.distinct(), "similar-found")
    discard(table_, sets)
    return all_


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of every node of `links` (a, b).

    Large-star and small-star in turn: every node's larger (then smaller) neighbours are linked to
    its smallest neighbour, until a round changes nothing."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(least, "u")
        out = met.where(F.col("v") > F.col("u")) if large else met
        new = out.select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            new = new.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return new.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def parts(n: int) -> int:
        """Files of a round's edges, of about a million each: a round has hardly more than the last."""
        return max(1, min(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), n >> 20))

    edges = stored(links.select("a", "b"), "stars")
    before = sign(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        last, edges = edges, stored(star(star(edges, True), False).coalesce(parts(before[0])), "stars")
        after = sign(edges)
        discard(last)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # The last round's edges stay: what follows reads them.
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def classes(docs: DataFrame, width: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """(key, h, fp, component, stays): component is the smallest key of the document's class, and
    stays is true for the row (or the equal rows) that has it.  `similar`: texts of similar sets of
    five-word shingles are linked, too."""
    fps = stored(fingerprints(docs, width, key, text, similar), "simhash")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("h").alias("h")))
    distinct = stored(fps.groupBy("fp").agg(first.alias("low"), F.count("*").alias("n")), "simhash-distinct")
    links = close_links(distinct.select("fp"), distance, blocks)
    if similar:
        # Each text once: copies have one sketch, and the text is that of one row (or of rows of one key).
        once = stored(fps.dropDuplicates(["h"]), "simhash-once")
        texts = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("t"))
        links = similar_links(once.select("fp", "h", F.col(key).alias("k"), "wide", "bands"), stored(links, "simhash-links"), texts)
        discard(once)
    roots = components(links)
    # Fingerprints without links are their own class; the rest meet at their root.
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "simhash-named")
    low = named.groupBy("root").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    of = spread_join(named.select("fp", "root", F.col("n").alias("rows")), low, ["root"], ["fp"], named.count())
    of = stored(of.select("fp", "low", F.col("rows").alias("n")), "simhash-classes")
    stays = F.col(key).eqNullSafe(F.col("low.key")) & (F.col("h") == F.col("low.h"))
    # One fingerprint's copies, and one class's fingerprints, may be a third of all rows.
    met = spread_join(fps.select(key, "h", "fp"), of, ["fp"], [key, "h"], fps.count())
    return met.select(key, "h", "fp", F.col("low.key").alias("component"), stays.alias("stays"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` of which one document of each class stays: that of the smallest key, of
    equal keys that of the smallest text hash, of equal rows one."""
    found = stored(classes(docs, key=key, text=text, **how), "simhash-stays")
    h = fresh(docs, "text_hash")
    same = lambda a, b: a[key].eqNullSafe(b[key]) & (a[h] == b["h"])
    rows, gone = docs.withColumn(h, F.xxhash64(text)), found.where("not stays").select(key, "h")
    gone = if_few(gone)
    kept = rows.join(gone, same(rows, gone), "left_anti")
    again = found.where("stays").groupBy(key, "h").count().where("count > 1").select(key, "h")
    if again.limit(1).count():  # repeated rows: one of each
        one = kept.join(again, same(kept, again), "left_semi").dropDuplicates([key, h])
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(one)
    return kept.drop(h)


def op8_simhash(spark, sf_dir):
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
