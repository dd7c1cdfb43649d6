"""Benchmark decontamination with an FM-index for each shard of training text.

Phrases: every window of `WIDTH` consecutive words of a benchmark item (an item of fewer words is
one window).  Words that no phrase has become 0.  Of a shard's documents the index takes the runs
of words whose neighbouring pairs all occur in phrases, for no window lies outside such a run;
runs shorter than the shortest window go too.

Index: suffixes are sorted by prefix doubling, the Burrows-Wheeler transform is a wavelet matrix,
suffix positions are sampled.  All phrases are searched backwards at once, one word at a step;
each step is two ranks.  Occurrences are located by walking to a sampled position.  The spans
that they cover are merged, and name the words to remove.

A shard is about `SHARD_BYTES` of text, so memory is bounded.  Phrases are broadcast where all of
them are in one block of `BLOCK_BYTES` of text; of more, each shard is searched for block after
block, read from the shared folder.

Defined results: a null text has no words; items without words have no window; items with one id
are one item; a null item id reads ``null``; repeated rows have a row each; an empty benchmark
leaves all clean; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import folder, opened, put_whole, ship, table

WIDTH = 10
SHARD_BYTES = 24 << 20
BLOCK_BYTES = 4 << 20  # about 80 MB of windows
PIECE_BYTES = 2 << 20
SAMPLED = 16
#: Words are runs of ASCII letters and digits (lower-cased) and of all bytes of other characters.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of items, as numbers, and whose they are."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + width]), set()).add(name)
        self.items = [sorted(x) for x in windows.values()]
        self.size = len(self.vocabulary) + 1
        self.by_length = {}
        for i, w in enumerate(windows):
            self.by_length.setdefault(len(w), []).append((i, w))
        self.by_length = {n: (np.array([i for i, _ in x]), np.array([w for _, w in x], np.int64)) for n, x in self.by_length.items()}
        pairs = [(w[:, :-1] * self.size + w[:, 1:]).ravel() for n, (_, w) in self.by_length.items() if n > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.single = np.unique(self.by_length[1][1]) if 1 in self.by_length else np.zeros(0, np.int64)
        self.shortest = min((n for n in self.by_length if n > 1), default=1 << 60)


class WaveletMatrix:
    """Ranks of symbols in a sequence, all queries of an array at once."""

    def __init__(self, sequence, size: int):
        import numpy as np

        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        s = sequence
        for level in reversed(range(self.levels)):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol, *ends):
        """How often `symbol` is in front of each end (arrays of one shape)."""
        import numpy as np

        at = [np.zeros(len(symbol), np.int64), *ends]
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            bit = (symbol >> level) & 1 == 1
            at = [np.where(bit, zeros + ones[i], i - ones[i]) for i in at]
        return [i - at[0] for i in at[1:]]

    def access_rank(self, i):
        """(symbol at i, its rank in front of i)"""
        import numpy as np

        low, symbol = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[i + 1] - ones[i]
            symbol = symbol * 2 + bit
            one = bit == 1
            i, low = (np.where(one, zeros + ones[x], x - ones[x]) for x in (i, low))
        return symbol, i - low


def suffix_order(text):
    """Suffixes in order; each 0 is a symbol of its own, smaller than others, in order of place."""
    import numpy as np

    n = len(text)
    rank = text.astype(np.int64) + n
    gaps = np.flatnonzero(text == 0)
    rank[gaps] = np.arange(len(gaps))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        s = rank[order]
        new = np.empty(n, np.int64)
        if step == 1:
            change = s[1:] != s[:-1]
        new[order] = np.concatenate([[0], np.cumsum(change)])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = rank[step:] + 1
        order = np.lexsort((nxt, rank))
        change = (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])
        step *= 2


class FMIndex:
    """Counts and places of word sequences in a text of numbers, in which 0 ends a run."""

    def __init__(self, text, size: int):
        import numpy as np

        self.n = len(text)
        order = suffix_order(text)
        self.wavelet = WaveletMatrix(text[order - 1], size)  # in front of the first stands the last, a 0
        counts = np.bincount(text, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # sampled: every SAMPLED-th position, and the starts of runs, so that no walk crosses a 0
        starts = np.concatenate([[True], text[:-1] == 0])
        self.sampled = (order % SAMPLED == 0) | starts[order] | (text[order] == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns):
        """(low, high) rows of each pattern (rows of equally many words)."""
        import numpy as np

        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[live, j]
            a, b = self.wavelet.rank(c, low[live], high[live])
            low[live], high[live] = self.first[c] + a, self.first[c] + b
            live = live[b > a]
        return low, np.maximum(low, high)

    def locate(self, rows):
        """Text positions of suffix rows."""
        import numpy as np

        out = np.empty(len(rows), np.int64)
        open_, at, walked = np.arange(len(rows)), rows, 0
        while len(open_):
            found = self.sampled[at]
            out[open_[found]] = self.samples[self.sample_rank[at[found]]] + walked
            open_, at = open_[~found], at[~found]
            c, r = self.wavelet.access_rank(at)
            at = self.first[c] + r
            walked += 1
        return out


def _pieces(texts: list[bytes | None]):
    """(from, to) of texts of about `PIECE_BYTES`."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= PIECE_BYTES or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def _runs(texts: list[bytes | None], phrases: Phrases, sizes):
    """(numbers of the texts' words with a 0 behind each text, first and last places of runs that a window may be in); the
    numbers of words are put into `sizes`."""
    import numpy as np

    get = phrases.vocabulary.get
    ids: list[int] = []
    for i, t in enumerate(texts):
        w = words(t)
        sizes[i] = len(w)
        ids += [get(x, 0) for x in w]
        ids.append(0)
    text = np.array(ids, np.int64)
    pair = text[:-1] * phrases.size + text[1:]
    at = np.searchsorted(phrases.pairs, pair)
    linked = np.zeros(len(text) + 1, bool)
    if len(phrases.pairs):
        linked[1:-1] = phrases.pairs[np.minimum(at, len(phrases.pairs) - 1)] == pair
    # linked[i]: words i - 1 and i may follow each other in a phrase
    first, last = np.flatnonzero(linked[1:] & ~linked[:-1]), np.flatnonzero(linked[:-1] & ~linked[1:])
    long_ = last - first + 1 >= phrases.shortest
    first, last = first[long_], last[long_]
    if len(phrases.single):
        alone = np.flatnonzero(np.isin(text, phrases.single))
        inside = np.searchsorted(first, alone, "right") - 1
        alone = alone[(inside < 0) | (alone > last[np.maximum(inside, 0)])] if len(first) else alone
        first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
        o = np.argsort(first)
        first, last = first[o], last[o]
    return text, first, last


def find(texts: list[bytes | None], phrases: Phrases):
    """(n_words of each text, array of hit (text, word), pairs of (text, window))."""
    import numpy as np

    sizes, firsts, lasts, runs, begin = np.zeros(len(texts), np.int64), [], [], [], 0
    # Piece after piece, and of each what is in runs: numbers of a whole shard's words would take ten times its text's room.
    for a, b in _pieces(texts):
        text, first, last = _runs(texts[a:b], phrases, sizes[a:b])
        runs += [np.append(text[i : j + 1], 0) for i, j in zip(first.tolist(), last.tolist())]
        firsts.append(first + begin)
        lasts.append(last + begin)
        begin += len(text)
    begins = np.cumsum(sizes + 1) - sizes - 1
    first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, lasts))
    none = (sizes, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64))
    if not len(first):
        return none
    n = last - first + 2  # a 0 behind each run
    ends = np.cumsum(n)
    place = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
    run = np.concatenate(runs)
    index = FMIndex(run, phrases.size)
    covered, met = np.zeros(len(run) + 1, np.int64), []
    for length, (windows, patterns) in phrases.by_length.items():
        low, high = index.search(patterns)
        rows = np.repeat(low, high - low) + _ranges(high - low)
        where = index.locate(rows)
        np.add.at(covered, where, 1)
        np.add.at(covered, where + length, -1)
        met.append(np.stack([np.searchsorted(begins, place[where], "right") - 1, np.repeat(windows, high - low)], axis=1))
    hit = place[np.flatnonzero(np.cumsum(covered[:-1]) > 0)]
    doc = np.searchsorted(begins, hit, "right") - 1
    return sizes, np.stack([doc, hit - begins[doc]], axis=1), np.unique(np.concatenate(met), axis=0)


def _ranges(n):
    """0..n[0]-1, 0..n[1]-1, ..."""
    import numpy as np

    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def merged(positions) -> list[dict]:
    """Sorted word positions as spans."""
    import numpy as np

    if not len(positions):
        return []
    cut = np.flatnonzero(np.diff(positions) > 1)
    starts, ends = positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [len(positions) - 1]])] + 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]


_loaded: dict[str, Phrases] = {}


def _block(path: str) -> Phrases:
    if path not in _loaded:
        _loaded.clear()
        store, at = opened(path)
        with store.open_input_stream(at, compression=None) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def _loader(benchmark: DataFrame, width: int, item: str, phrase: str):
    """A function that gives the workers the phrases, block after block."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(phrase).cast("binary").alias("t")).where(F.octet_length("t") > 0)
    # Block after block comes to the driver, each of a bounded size.
    to, blocks, held, size = folder(spark, "phrases"), 0, [], 0
    for r in items.toLocalIterator():
        held.append((r[0], bytes(r[1])))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            put_whole(f"{to}/{blocks:05d}", lambda out: out.write(pickle.dumps(Phrases(held, width))))
            blocks, held, size = blocks + 1, [], 0
    if blocks:
        if held:
            put_whole(f"{to}/{blocks:05d}", lambda out: out.write(pickle.dumps(Phrases(held, width))))
            blocks += 1
        paths = [f"{to}/{i:05d}" for i in range(blocks)]
        return lambda: map(_block, paths)
    kept = spark.sparkContext.broadcast(Phrases(held, width))
    return lambda: [kept.value]


def _shards(batches, at: int):
    """Lists of batches with about SHARD_BYTES of text (column `at`), and their texts."""
    held, texts, size = [], [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            got = b.column(at).cast("binary").to_pylist()
            texts += got
            size += sum(len(t) for t in got if t)
        if size >= SHARD_BYTES or len(texts) > 200_000:
            yield held, texts
            held, texts, size = [], [], 0
    if texts:
        yield held, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", phrase: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, spans) of every row; spans count words."""
    load = _loader(benchmark, width, item, phrase)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([StructField(key, docs.schema[key].dataType), *(StructField(c, LongType()) for c in ("n_words", "n_hit", "n_items")), StructField("items_sha256", StringType()), StructField("spans", ArrayType(span))])

    def work(batches):
        import numpy as np
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def shard(keys, texts):
            n, hits, names = None, [], [set() for _ in texts]
            for phrases in load():
                n, hit, met = find(texts, phrases)
                hits.append(hit)
                for d, w in met.tolist():
                    names[d].update(phrases.items[w])
            hit = np.unique(np.concatenate(hits), axis=0)
            edges = np.searchsorted(hit[:, 0], np.arange(len(texts) + 1))
            spans = [merged(hit[a:b, 1]) for a, b in zip(edges, edges[1:])]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(n), pa.array(np.diff(edges)), pa.array([len(x) for x in names], pa.int64()), pa.array(digest), pa.array(spans, spans_type)], names=[f.name for f in schema])

        for held, texts in _shards(batches, 1):
            yield shard([b.column(0) for b in held], texts)

    return docs.select(F.col(key), F.col(text).cast("binary").alias("t")).mapInArrow(work, schema)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id", phrase: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs."""
    load = _loader(benchmark, width, item, phrase)
    at = docs.columns.index(text)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for held, texts in _shards(batches, at):
            clean = np.ones(len(texts), bool)
            for phrases in load():
                clean[find(texts, phrases)[1][:, 0]] = False
            done = 0
            for b in held:
                yield b.filter(pa.array(clean[done : done + b.num_rows]))
                done += b.num_rows

    return docs.mapInArrow(work, docs.schema)


def op10_decontamination(spark, sf_dir):
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda w: w <> ''), []) AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
