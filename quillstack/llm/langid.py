"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed text.

Learning: of each language a bounded number of labelled documents (about `TRAIN_DOCS`, those of
smallest hash) is read whole; hashed byte n-grams of their words give log-probabilities, and
the scripts of their letters say which languages a script can be.

A further state, noise, is learned from the same words: their letters in another order, and letters
drawn evenly from theirs.  So letters that are no words have a better explanation than any language.

Predicting: every word of the whole text scores each candidate language and noise; Viterbi with a
switching penalty finds the best sequence of them; runs of one language are spans, those of noise are
``und``.  The text's language is that with most letters, the score its share of all letters times the
confidence of its words' sums: low for noise, and about a half for a text half in one and half in another language.

A path of one language is the best one if no other gains more than one penalty on any stretch (a
detour of k stretches costs at least k penalties) and no two together on a first and a last stretch
(a path wholly outside the language has k stretches, but k - 1 penalties); that is tested with running
minima, and only other texts go through the full recursion.

Defined results: null text, or one without a letter: ``und`` and 0; letters of an unknown script
alone: the most frequent language and 0; noise alone: the likeliest language and 0; no labelled rows: ``und`` and 0 for all; a null key is
held out; words (runs of letters) over 32 letters are read in pieces of 32; repeated rows are predicted each; an
empty table gives an empty result; other columns are ignored, and lang is read in learning alone.
"""

from __future__ import annotations

import random
import zlib
from itertools import compress, repeat
from operator import is_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import give_back, ship, table

#: Every label is a language that is learned; each takes 128 KB of the model.
TRAIN_DOCS = 400
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
PENALTY = 8.0
FOLDS = 5
#: Where documents are filtered, those at or under this score are rejected.  Texts of two languages in
#: halves stay; tests/llm has the shares of clean, mixed, junk and foreign texts that stay.
LEAST_SCORE = 0.25
#: Tokens that a task remembers with their scores, about 150 bytes each.
REMEMBERED = 250_000
PIECE = 32
#: A language has a script if this share of its letters is of it.
SCRIPT_SHARE = 0.02
# First code points of Unicode script ranges.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
]
NAMES = sorted({n for _, n in SCRIPTS})


def script(letter: str) -> str:
    import bisect

    i = bisect.bisect_right(SCRIPTS, (ord(letter), "~")) - 1
    return SCRIPTS[max(i, 0)][1]


#: A-Z become small, other ASCII characters but a-z become spaces.
TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TOKENS).split() if text else []


def pieces(token: bytes) -> list[bytes]:
    """The runs of letters of a token, lower-cased, in pieces of at most PIECE letters."""
    if token.isascii():
        return [token] if len(token) <= PIECE else [token[i : i + PIECE] for i in range(0, len(token), PIECE)]
    t = token.decode("utf-8", "replace").lower()
    runs = [t] if t.isalpha() else "".join(c if c.isalpha() else " " for c in t).split()
    return [r[i : i + PIECE].encode() for r in runs for i in range(0, len(r), PIECE)]


def grams(words: list[bytes]):
    """(buckets, owner): buckets of the words' byte n-grams, with a word's ends marked, and of the
    words themselves; owner is the word's place."""
    import numpy as np

    raw = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, words), int, len(words)) + 2
    of = np.repeat(np.arange(len(words)), n)
    buckets, owner = [], []
    code = np.zeros(len(raw), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        code = code[: len(raw) - k + 1] * np.uint64(257) + raw[k - 1 :]
        if k in GRAMS:
            own = of[: len(code)] == of[k - 1 :]
            h = (code[own] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h >> np.uint64(40)).astype(int) % BUCKETS)
            owner.append(of[: len(code)][own])
    buckets.append(np.fromiter((zlib.crc32(w) % BUCKETS for w in words), int, len(words)))
    owner.append(np.arange(len(words)))
    return buckets, owner


def script_of(word: bytes) -> str:
    return "latin" if word[0] < 128 else script(word.decode()[0])


def scrambled(word: bytes) -> list[bytes]:
    """A word's letters in another order, and as many drawn evenly from its letters' range: always the same."""
    letters = list(word.decode())
    rng = random.Random(zlib.crc32(word))
    rng.shuffle(letters)
    known = "abcdefghijklmnopqrstuvwxyz" if word.isascii() else letters
    return ["".join(letters).encode(), "".join(rng.choices(known, k=len(letters))).encode()]


class Model:
    """Log-probabilities of n-grams, of each language and (last) of noise, and the languages' scripts."""

    def __init__(self, langs: list[str], counts, scripts, documents):
        """`counts` has a column for each language and one for noise."""
        import numpy as np

        self.langs = langs
        if not langs:
            return
        logp = np.log((counts + 0.05) / (counts.sum(0, keepdims=True) + 0.05 * BUCKETS))
        self.logp = (logp - logp[:, :-1].mean(1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        self.of_script = {n: np.append(share[i] >= SCRIPT_SHARE, True) for i, n in enumerate(NAMES)}
        self.usual = int(np.argmax(documents))

    def words(self, words: list[bytes]):
        """Scores of words: one row each, noise last; languages that the word's script rules out get -20."""
        import numpy as np

        s = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return s
        n = np.zeros(len(words))
        for buckets, owner in zip(*grams(words)):
            if len(buckets):
                sums = np.vstack([np.zeros(s.shape[1]), np.cumsum(self.logp[buckets], axis=0, dtype=float)])
                ends = np.searchsorted(owner, np.arange(len(words) + 1))
                s += sums[ends[1:]] - sums[ends[:-1]]
                n += np.diff(ends)
        s /= np.sqrt(n)[:, None]
        for name in set(map(script_of, words)):
            can = self.of_script[name]
            if not can.all():
                own = np.fromiter((script_of(w) == name for w in words), bool, len(words))
                s[own] = np.where(can, s[own], -20) if can[:-1].any() else 0
        return s


def viterbi(s, penalty: float = PENALTY):
    """Best language of each word (rows of `s`), where each change costs `penalty`."""
    import numpy as np

    n, k = s.shape
    if k < 2 or n == 0:
        return np.zeros(n, int)
    top = int(s.sum(0).argmax())
    gain = np.zeros((n + 1, k))
    np.cumsum(s - s[:, top : top + 1], axis=0, out=gain[1:])
    around = gain.max() + (gain[-1] - gain).max()  # of a first and a last stretch outside
    if around <= penalty and (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(n, top)
    rows = s.tolist()
    cost, back = rows[0][:], []
    span = range(k)
    for row in rows[1:]:
        best = max(cost)
        at = cost.index(best)
        floor = best - penalty
        back.append([j if cost[j] >= floor else at for j in span])
        cost = [(c if c >= floor else floor) + r for c, r in zip(cost, row)]
    path = [cost.index(max(cost))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return np.array(path[::-1])


class Reader:
    """Predicts texts; remembers the scores of tokens."""

    TEXTS = 1 << 19

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.at: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.langs) + 1), np.float32)
        self.letters = np.zeros(1 << 12, np.int32)

    def learn(self, new: list[bytes]) -> None:
        import numpy as np

        words = [pieces(t) for t in new]
        flat = [w for x in words for w in x]
        n = np.fromiter(map(len, words), int, len(words))
        sums = np.vstack([np.zeros(len(self.model.langs) + 1), np.cumsum(self.model.words(flat), axis=0)])
        ends = np.concatenate([[0], np.cumsum(n)])
        base, end = len(self.at), len(self.at) + len(new)
        while end > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.scores[base:end] = sums[ends[1:]] - sums[ends[:-1]]
        self.letters[base:end] = [sum(len(w) if w.isascii() else len(w.decode()) for w in x) for x in words]
        self.at.update(zip(new, range(base, end)))

    def read_all(self, texts: list[str | None]):
        """What `read` gives, for each text."""
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end] or "") <= self.TEXTS):
                held += len(texts[end] or "")
                end += 1
            words = [tokens(t) for t in texts[start:end]]
            if self.model.langs:
                found = [list(map(self.at.get, w)) for w in words]
                new = set()
                for w, f in zip(words, found):
                    new.update(compress(w, map(is_, f, repeat(None))))
                if new:
                    if len(self.at) + len(new) > REMEMBERED:
                        self.clear()
                        new, found = set().union(*words), [[None]] * len(words)
                    self.learn(list(new))
                for w, f in zip(words, found):
                    yield self._of(list(map(self.at.__getitem__, w)) if None in f else f)
            else:
                yield from [("und", 0.0, [])] * len(words)
            start = end

    def read(self, text: str | None):
        """(language, score, [(first word, end, language)])"""
        return next(self.read_all([text]))

    def _of(self, ids: list[int]):
        import numpy as np

        if not ids:
            return "und", 0.0, []
        ids = np.array(ids)
        letters = self.letters[ids]
        total = int(letters.sum())
        if not total:
            return "und", 0.0, []
        s = self.scores[ids]
        if not s.any():
            return self.model.langs[self.model.usual], 0.0, []
        path = viterbi(s)
        n = len(self.model.langs)
        weight = np.bincount(path, letters, n + 1)[:n]
        best = int(weight.argmax()) if weight.any() else int(s[:, :n].sum(0).argmax())
        own = s[path == best, :n] if (path != best).any() else s[:, :n]  # the words that it is given
        sums = own.sum(0, dtype=float)
        sure = 1 / np.exp(np.minimum((sums - sums[best]) / np.sqrt(max(1, len(own))), 50)).sum()
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        names = [*self.model.langs, "und"]
        spans = [(a, b, names[path[a]]) for a, b in zip(edges, edges[1:])]
        return names[best], float(min(1.0, weight[best] / total * sure)), spans


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labelled rows that aren't held out."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k")))
    sizes = sorted(rows.groupBy("l").count().collect())
    if not sizes:
        return Model([], None, None, [])
    langs = [r[0] for r in sizes]
    shares = spark.createDataFrame([(r[0], min(1.0, train_docs / r[1])) for r in sizes], "l string, share double")
    part = F.shiftrightunsigned(F.xxhash64("k", "t"), 11) / F.lit(float(1 << 53))
    sample = rows.join(F.broadcast(shares), "l").where(part < F.col("share")).select("l", "t")

    def count(batches):
        import pyarrow as pa

        total: dict[str | None, np.ndarray] = {}

        def add(l, flat):
            if l not in total:
                total[l] = np.zeros(BUCKETS + len(NAMES), np.int64)
            if flat:
                total[l][:BUCKETS] += np.bincount(np.concatenate(grams(flat)[0]), minlength=BUCKETS)

        for b in batches:
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat = [w for x in tokens(t) for w in pieces(x)]
                add(l, flat)
                add(None, [x for w in flat for x in scrambled(w)])
                for w in flat:
                    total[l][BUCKETS + NAMES.index(script_of(w))] += len(w)
        for l, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["l", "at", "n"])

    counts = np.zeros((BUCKETS + len(NAMES), len(langs) + 1))
    column = {l: i for i, l in enumerate([*langs, None])}
    summed = sample.mapInArrow(count, "l string, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most languages x (BUCKETS + scripts) numbers
        counts[r[1], column[r[0]]] = r[2]
    return Model(langs, counts[:BUCKETS], counts[BUCKETS:, :-1], [r[1] for r in sizes])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans) of every row; spans count words."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span))])

    def work(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        reader = Reader(shared.value)
        for b in batches:
            got = list(reader.read_all(b.column(1).to_pylist()))
            spans = pa.array([[{"start": x, "end": y, "lang": l} for x, y, l in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], names=[key, "lang_pred", "score", "spans"])

    return docs.select(key, text).mapInArrow(work, schema)


def with_language(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE, langs: list[str] | None = None) -> DataFrame:
    """The rows of `docs` that have a language (of `langs`, if given) with a score over `least`."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches):
        import pyarrow as pa

        reader = Reader(shared.value)
        for b in batches:
            got = [g[:2] for g in reader.read_all(b.column(at).to_pylist())]
            yield b.filter(pa.array([l != "und" and s > least and (langs is None or l in langs) for l, s in got], pa.bool_()))
        reader = b = got = None
        give_back()

    return docs.mapInArrow(work, docs.schema)


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
