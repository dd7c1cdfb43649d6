"""Repeated passages: runs of `WINDOW` words that also start in a document of a smaller id are removed.

Recompression names the words of all texts level by level.  A level first names maximal runs of one symbol, (symbol,
length), then the pairs of a left and a right symbol, where a bit of a symbol's name says which it is.  A name is a 64-bit
mix of what it stands for, so it is the same in every task and document, and no exchange is needed to agree on
it.  What a symbol depends on is known exactly: the words from `lo` to `hi`, those that it stands for and those
beside them that decided where it begins and ends.  Any two occurrences of these words have the same symbol in
them; so if a window that holds them occurs in two documents, both have that symbol.

Each window is judged by the highest level that has a symbol in it, with all it depends on; every window has its words.
The first round of Spark finds which of these symbols several documents have.  A window with one that a
single document has is unique, which leaves few others.  The second round verifies those by 128-bit names of their 50
words (prefix sums of two hashes a word) and finds the smallest document of each.  No pairs of documents are made: a
name's documents meet in its smallest.  Hot names are dealt over several tasks.

Documents that are word for word the same are one for this search: all but the first go whole, by the hash of
their words.  Long texts are taken in pieces that overlap by a window less a word, so memory is bounded.

Defined results: null and empty texts have no words; texts of fewer words than a window lose nothing; rows of one id
don't make each other go, be they equal or not; a null id is neither smaller nor larger than any, so its rows
lose nothing and make nothing go; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, if_few, ship, spread_join, stored, table

#: Words of a window, and levels of recompression: a symbol stands for (4/3) ** LEVELS words on the average.
WINDOW, LEVELS = 50, 7
#: Words of a piece of text, and of the pieces that are compressed at once.
PIECE, AT_ONCE = 1 << 15, 1 << 16
#: Odd multipliers of the two sums that name a window.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x, seed: int):
    """A bijective mix of 64-bit values, another one for each seed."""
    import numpy as np

    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """Symbols over words: names, whether one is a border between texts, the words from start to end that a symbol
    stands for, and those from lo to hi that it depends on."""

    __slots__ = ("name", "border", "start", "end", "lo", "hi")

    def __init__(self, name, border, start, end, lo, hi):
        self.name, self.border, self.start, self.end, self.lo, self.hi = name, border, start, end, lo, hi


def base(words, border) -> Level:
    """The words themselves, as symbols."""
    import numpy as np

    at = np.arange(len(words), dtype=np.int64)
    return Level(words, border, at, at + 1, at, at + 1)


def runs(x: Level, words, seed: int) -> Level:
    """Maximal runs of one symbol named."""
    import numpy as np

    n = len(x.name)
    same = (x.name[1:] == x.name[:-1]) & ~x.border[1:] & ~x.border[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = np.where(length > 1, _mix(x.name[first] ^ _mix(length.astype(np.uint64), seed), seed), x.name[first])
    start, end, lo, hi = x.start[first], x.end[last], x.lo[first], x.hi[last]
    # A run ends where the symbol beside it differs: the nearest word shows it, if it isn't the word that the run's symbol
    # has there; else all that the symbol beside depends on.
    out = ~x.border[first]
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    clear = words[np.maximum(start - 1, 0)] != words[end - 1]
    lo = np.where(out & (first > 0), np.where(clear | x.border[before], np.minimum(lo, start - 1), np.minimum(lo, x.lo[before])), lo)
    clear = words[np.minimum(end, len(words) - 1)] != words[start]
    hi = np.where(out & (last < n - 1), np.where(clear | x.border[after], np.maximum(hi, end + 1), np.maximum(hi, x.hi[after])), hi)
    return Level(name, x.border[first], start, end, lo, hi)


def pairs(x: Level, seed: int) -> Level:
    """Pairs of a left symbol and the right one after it named."""
    import numpy as np

    n = len(x.name)
    left = (_mix(x.name, seed) >> np.uint64(63) == 1) & ~x.border
    right = ~left & ~x.border
    opens = np.append(left[:-1] & right[1:], False)
    closes = np.concatenate([[False], opens[:-1]])
    at = np.flatnonzero(~closes)
    paired = opens[at]
    to = np.where(paired, at + 1, at)
    name = np.where(paired, _mix(x.name[at] * np.uint64(_BASES[0]) + _mix(x.name[to], seed + 1), seed + 2), x.name[at])
    # What is a left one alone depends on the symbol after it, a right one on that before.
    lo = np.minimum(x.lo[at], np.where(~paired & right[at], x.lo[np.maximum(at - 1, 0)], x.lo[at]))
    hi = np.maximum(x.hi[to], np.where(~paired & left[at], x.hi[np.minimum(at + 1, n - 1)], x.hi[to]))
    return Level(name, x.border[at], x.start[at], x.end[to], lo, hi)


def levels(words, border, count: int) -> list[Level]:
    """The words and `count` levels over them, the highest first."""
    out = [base(words, border)]
    for k in range(count):
        out.append(pairs(runs(out[-1], words, 4 * k + 3), 4 * k))
    return out[::-1]


def _covered(lo, hi, size: int, window: int):
    """Which windows hold one of the stretches from lo to hi."""
    import numpy as np

    begin, end = np.bincount(np.maximum(hi - window, 0), minlength=size + 1), np.bincount(lo + 1, minlength=size + 1)
    return np.cumsum(begin - end)[:-1] > 0


def judged(found: list[Level], valid, window: int, known=None):
    """For `known` None the symbols that windows are judged by, as (places, names), else which windows of `valid` have
    none but symbols for which known(names, places) holds."""
    import numpy as np

    size, open_, alive = len(valid), valid.copy(), valid.copy()
    where, names = [], []
    for k, x in enumerate(found):
        if not open_.any():
            break
        fits = ~x.border & (x.hi - x.lo <= window)
        lo, hi, name = x.lo[fits], x.hi[fits], x.name[fits]
        so_far = np.concatenate([[0], np.cumsum(open_)])
        used = so_far[lo + 1] > so_far[np.maximum(hi - window, 0)]
        lo, hi, name = lo[used], hi[used], _mix(name[used], 1000 + len(found) - k)
        if known is None:
            where.append(lo)
            names.append(name)
        else:
            dead = ~known(name, lo)
            alive &= ~(_covered(lo[dead], hi[dead], size, window) & open_)
        open_ &= ~_covered(lo, hi, size, window)
    if known is None:
        return (np.concatenate(where), np.concatenate(names)) if where else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return alive


def chunks(texts, window: int):
    """Texts, as (row, words), in chunks of (first and second halves of words' hashes, border, valid, rows, offsets): pieces with a border around
    each; row and place in its text of every place; valid where a window begins."""
    import numpy as np
    from xxhash import xxh3_128_digest

    def made(pieces):
        size = sum(len(p[2]) + 1 for p in pieces) + 1
        words, second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        border, valid = np.ones(size, bool), np.zeros(size, bool)
        rows, offsets, at = np.zeros(size, np.int64), np.zeros(size, np.int64), 1
        for row, offset, own in pieces:
            to = at + len(own)
            words[at:to], second[at:to] = own[:, 0], own[:, 1]
            border[at:to], valid[at : to - window + 1] = False, True
            rows[at:to], offsets[at:to] = row, np.arange(offset, offset + len(own))
            at = to + 1
        return words, second, border, valid, rows, offsets

    pieces, size = [], 0
    for row, words in texts:
        for a in range(0, max(1, len(words) - window + 1), PIECE):
            some = words[a : a + PIECE + window - 1]
            if len(some) < window:
                continue
            own = np.frombuffer(b"".join(map(xxh3_128_digest, some)), np.uint64).reshape(-1, 2)
            pieces.append((row, a, own))
            size += len(own)
            if size >= AT_ONCE:
                yield made(pieces)
                pieces, size = [], 0
    if pieces:
        yield made(pieces)


def _split(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def symbols(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, count: int = LEVELS) -> DataFrame:
    """(key, h, n_words, sha, names) of every row: a hash of the text, the SHA-256 of its words joined by blanks, and the
    different names of the symbols that its windows are judged by."""
    ship(docs.sparkSession)

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, sha, names = [], [], [np.zeros(0, np.uint64)] * len(b)

            def each(b=b, n=n, sha=sha):
                for row, t in enumerate(b.column(2)):
                    words = _split(t.as_py())
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) >= window:
                        yield row, words

            for words, _, border, valid, rows, _ in chunks(each(), window):
                where, found = judged(levels(words, border, count), valid, window)
                of = rows[where]
                order = np.lexsort((found, of))
                of, found = of[order], found[order]
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])[: len(of)]
                of, found = of[new], found[new]
                for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else ():
                    row = of[part[0]]
                    names[row] = np.union1d(names[row], found[part]) if len(names[row]) else found[part]
            values = np.concatenate(names) if len(b) else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], names=["key", "h", "n_words", "sha", "names"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    some = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("t"))
    return some.mapInArrow(work, f"key {kind}, h long, n_words long, sha string, names array<long>")


def windows(texts: DataFrame, window: int = WINDOW, count: int = LEVELS) -> DataFrame:
    """(key, h, at, a, b): the windows of (key, h, t, known) all of whose symbols are among the row's known ones, with
    the first word's place and a 128-bit name."""
    kind = texts.schema["key"].dataType.simpleString()
    ship(texts.sparkSession)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        inverse = [np.uint64(pow(m, -1, 1 << 64)) for m in _BASES]
        for b in batches:
            known = b.column(3)
            flat, ends = known.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in known])])
            rows_of = np.repeat(np.arange(len(b)), np.diff(ends))
            # A name in one row: both mixed to one value, as a name that is in another row only is not known here.
            in_row = np.sort(_mix(flat, 7) ^ _mix(rows_of.astype(np.uint64), 8))
            for words, second, border, valid, rows, offsets in chunks(((i, _split(t.as_py())) for i, t in enumerate(b.column(2))), window):

                def is_known(names, places, rows=rows):
                    x = _mix(names, 7) ^ _mix(rows[places].astype(np.uint64), 8)
                    at = np.minimum(np.searchsorted(in_row, x), max(0, len(in_row) - 1))
                    return in_row[at] == x if len(in_row) else np.zeros(len(x), bool)

                at = np.flatnonzero(judged(levels(words, border, count), valid, window, is_known))
                named = []
                for hashed, m, back in zip((words, second), _BASES, inverse):
                    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), m, np.uint64))])
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashed, 9) * powers[:-1], dtype=np.uint64)])
                    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), back, np.uint64))])
                    named.append(pa.array(_mix((sums[at + window] - sums[at]) * down[at], 10).view(np.int64)))
                row = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(offsets[at].astype(np.int32)), *named], names=["key", "h", "at", "a", "b"])
            pa.default_memory_pool().release_unused()

    return texts.select("key", "h", "t", "known").mapInArrow(work, f"key {kind}, h long, at int, a long, b long")


def kept_words(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, h, n_removed, sha) of (key, h, t, places): what is left without the windows that begin at the places."""
    kind = texts.schema["key"].dataType.simpleString()
    ship(texts.sparkSession)

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, sha = [], []
            for t, places in zip(b.column(2), b.column(3)):
                words = np.array(_split(t.as_py()), object)
                marks = np.zeros(len(words) + 1, np.int64)
                at = np.unique(places.values.to_numpy())
                marks[at] += 1
                marks[at + window] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(words[~gone].tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["key", "h", "n_removed", "sha"])

    return texts.select("key", "h", "t", "places").mapInArrow(work, f"key {kind}, h long, n_removed long, sha string")


def _shared(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, low, n) of those that several documents of `rows` have."""
    of = rows.groupBy(*keys).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    return stored(of.where("low < high").drop("high"), name)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, count: int = LEVELS) -> DataFrame:
    """(key, n_words, n_removed, sha) of every row of `docs`; sha is that of the words that are kept, joined by blanks."""
    import hashlib

    all_ = stored(symbols(docs, key, text, window, count), "repeats-symbols")
    rows = stored(all_.drop("names"), "repeats-rows")
    long_ = all_.where((F.col("n_words") >= window) & F.col("key").isNotNull())
    total = all_.agg(F.count("*"), F.sum(F.size("names"))).first()
    # Equal documents: all but the first go whole.
    same = _shared(long_, ["sha"], "repeats-same")
    gone = spread_join(long_.select("key", "h", "sha"), same, ["sha"], ["key", "h"], total[0]).where("key > low").select("key", "h").distinct()
    gone = stored(gone, "repeats-gone")
    once = long_
    if long_.groupBy("key", "h").count().where("count > 1").limit(1).count():
        once = long_.dropDuplicates(["key", "h"])  # repeated rows
    named = once.join(if_few(gone), ["key", "h"], "left_anti").select("key", "h", F.explode("names").alias("name"))
    # Which symbols do several documents have?
    several = _shared(named, ["name"], "repeats-shared")
    known = spread_join(named, several.select("name", "n"), ["name"], ["key", "h"], total[1] or 0)
    known = stored(known.groupBy("key", "h").agg(F.collect_list("name").alias("known")), "repeats-known")
    discard(all_, several, same)  # what nothing reads any more makes room for what follows
    # Which windows?
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("t"))
    wanted = lambda of: texts.join(if_few(of.select("key", "h").distinct()), ["key", "h"], "left_semi").dropDuplicates(["key", "h"])
    found = stored(windows(wanted(known).join(known, ["key", "h"]), window, count), "repeats-windows")
    discard(known)
    first = _shared(found, ["a", "b"], "repeats-first")
    hits = spread_join(found, first, ["a", "b"], ["key", "at"], found.count()).where("key > low")
    hits = stored(hits.groupBy("key", "h").agg(F.collect_list("at").alias("places")), "repeats-places")
    discard(found, first)
    cut = kept_words(wanted(hits).join(hits, ["key", "h"]), window)
    whole = gone.join(rows.select("key", "h", F.col("n_words").alias("n_removed")), ["key", "h"]).distinct().withColumn("sha", F.lit(hashlib.sha256(b"").hexdigest()))
    changed = stored(cut.unionByName(whole).withColumnRenamed("sha", "kept"), "repeats-changed")
    discard(hits, gone)
    out = rows.join(if_few(changed), ["key", "h"], "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("sha"))


def op13_repeats(spark, sf_dir):
    return removed(table(spark, sf_dir, "documents")).withColumnRenamed("sha", "kept_sha256")
