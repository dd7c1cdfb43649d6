"""Operators 11 to 13 against brute force, on small tables and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import divergence, repeats, spelling
from quillstack.llm.queries import QUERIES

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, source string, n int, word string, term string, key string, h long, p int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source), and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, 3) for r in rows], CLASHING)


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- 11 ---
def brute_divergence(rows, least_docs, k):
    rows = [(t or "", l or "", s or "") for _, t, l, s in rows]
    docs, n, all_n = collections.Counter(), collections.Counter(), collections.Counter()
    for t, l, s in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(A_Z))
        n.update((l, s, x) for x in terms)
        all_n.update((l, x) for x in terms)
        docs.update((l, x) for x in set(terms))
    out = []
    groups = sorted({(l, s) for _, l, s in rows})
    for l in {l for l, _ in groups}:
        kept = [x for (m, x), d in docs.items() if m == l and d >= least_docs]
        share = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))
        mine = [s for m, s in groups if m == l]
        p = {s: {x: share(n[l, s, x], sum(n[l, s, y] for y in kept)) for x in kept} for s in mine}
        q = {x: share(all_n[l, x], sum(all_n[l, y] for y in kept)) for x in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            part = sorted((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in mine if o != s)
            out += [(l, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(part)]
            part = sorted((-f(p[s][x], q[x]), x.encode()) for x in kept if n[l, s, x] and p[s][x] > q[x])[:k]
            out += [(l, s, "term", x.decode(), -v, i + 1) for i, (v, x) in enumerate(part)]
    return sorted(out, key=repr)


TERM_COLUMNS = "lang", "source", "part", "item", "value", "rank"


def test_divergence_edges(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉT", "中文", "x" * 5000, "b", "bb", "bé"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), "en", rng.choice(["s1", "s2", "s3", None])) for i in range(60)]
    rows += [(None, None, None, None), (1, None, "de", "s1"), (1, "", "de", "s2"), (2, "only one", "fr", "s1"), (3, "!!! 123 \x00\x7f", "en", "none")]
    rows += [(7, "alpha " * 20_000, "en", "s1")] * 3
    df = frame(spark, rows)
    for least, k in ((1, 3), (4, 10), (1000, 10)):
        assert as_rows(divergence.audit(df, least_docs=least, k=k), *TERM_COLUMNS) == brute_divergence(rows, least, k)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert as_rows(QUERIES["op11_divergence"](spark, sf), *TERM_COLUMNS) == brute_divergence(rows, 10, 10)


@pytest.mark.parametrize("few", [0, 50])
def test_radix_ranks(spark, few):
    """Many ties, long shared beginnings, items that begin with others, groups of fewer rows than places."""
    rng = random.Random(5)
    rows = {("g1", "p" * rng.randrange(40) + rng.choice("abé中") * rng.randrange(1, 4)): rng.choice([0, 1, 5, 2**30 - 1]) for _ in range(400)}
    rows |= {("g2", f"i{i}"): 7 for i in range(3)} | {("g3", f"{'a' * i}"): 9 for i in range(1, 60)} | {("g4", f"{i:05d}"): i for i in range(2000)} | {(None, "x"): 1}
    rows = {(g or "", i): v for (g, i), v in rows.items()}
    df = spark.createDataFrame([(g, i, v) for (g, i), v in rows.items()], "g string, item string, value long")
    want = []
    for g in {g for g, _ in rows}:
        mine = sorted((-v, i.encode()) for (h, i), v in rows.items() if h == g)[:10]
        want += [(g, i.decode(), -v, r + 1) for r, (v, i) in enumerate(mine)]
    assert as_rows(divergence.top_ranks(df, ["g"], 10, few=few), "g", "item", "value", "rank") == sorted(want, key=repr)


def test_shares_are_exact(spark):
    n, total = 3 * 10**15 + 7, 7 * 10**15 + 1
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total)).alias("p"), divergence.apart(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert tuple(got) == (1 + 10**9 * (n + 2) // total, (10**9) ** 2 // (10**9 + 2))


def test_a_source_with_a_third_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=8)), "en", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(900)]
    assert as_rows(divergence.audit(frame(spark, rows)), *TERM_COLUMNS) == brute_divergence(rows, 10, 10)


# --- 12 ---
def brute_spelling(rows, noise=199, least_length=6, least=5, factor=5):
    counts = collections.Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(A_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least}
    by_rest = collections.defaultdict(set)
    for w in n:
        by_rest[w].add(w)
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: {o for r in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for o in by_rest[r] if o != w and one_apart(w, o)} for w in n}
    form = {}
    for w, c in n.items():
        best = min(((-n[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= factor * c else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n), key=repr)


WORD_COLUMNS = "word", "form", "root", "n", "n_near", "form_n"


def spelled(df, **how):
    return spelling.variants(spelling.word_counts(df, **how).where(f"n >= {spelling.LEAST_COUNT}"))


def test_spelling_edges(spark):
    long_ = "abcdefghijklmnopqrstuvwxyzéü" * 40
    words = {"letter": 700, "leter": 9, "lettter": 130, "lettters": 25, "letttersz": 5, "better": 140, "bettér": 6, "Letter": 3, "ÉTÉÉÉÉ": 5, "étéééé": 30, "aaaaaa": 26, "aaaaaaa": 5, "baaaaa": 5, "ab×÷ab": 5, long_: 30, long_[:-1]: 5, long_ + "é": 6, "x" * 20_000: 5, "tiesss": 50, "tiessa": 250, "tiessb": 250}
    rows = [(i, " ".join([w] * 5), "en", "s") for i, (w, n) in enumerate((w, n) for w, n in words.items() for _ in range(n // 5))]
    rows += [(1000 + i, w, "en", "s") for i, (w, n) in enumerate((w, n) for w, n in words.items() for _ in range(n % 5))]
    rows += [(None, "letter letter", None, None), (3, None, None, None), (4, "", None, None), (5, "ł letteŕ 123letter_letter 中letter", None, None), rows[0], rows[0]]
    got = as_rows(spelled(frame(spark, rows)), *WORD_COLUMNS)
    assert got == brute_spelling(rows)
    got = as_rows(spelled(frame(spark, rows), noise=1 << 40), *WORD_COLUMNS)
    assert got == brute_spelling(rows, noise=1 << 40)
    assert {r[0]: r[2] for r in got}["letttersz"] == "letter"  # by way of lettters and lettter
    assert {r[0]: r[1] for r in got}["tiesss"] == "tiessa"  # of equal n the first
    assert as_rows(spelled(frame(spark, rows), noise=2), *WORD_COLUMNS) == brute_spelling(rows, noise=2)
    assert spelled(frame(spark, rows).limit(0)).count() == 0


def test_spelling_of_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(QUERIES["op12_spelling"](spark, sf), *WORD_COLUMNS) == brute_spelling(rows)


def test_whole_neighbourhood(spark):
    """With a field that lets all through, each string of one edit is made, once."""
    words = ["aab", "ab", "a", "ééa"]
    df = spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
    made = [tuple(r) for r in spelling.candidates(df, "abé", 16, np.full(1 << 10, -1, np.int64)).collect()]
    want = set()
    for w in words:
        for i in range(len(w) + 1):
            want |= {(w, w[:i] + c + w[i:]) for c in "abé"} | {(w, w[:i] + c + w[i + 1 :]) for c in "abé" if i < len(w)} | ({(w, w[:i] + w[i + 1 :])} if i < len(w) else set())
    assert len(made) == len(set(made)) and set(made) == {(w, x) for w, x in want if w != x}


# --- 13 ---
def brute_repeats(rows, window=50):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words):
        for a in range(len(w) - window + 1) if i is not None else ():
            s = tuple(w[a : a + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


REPEAT_COLUMNS = "doc_id", "n_words", "n_removed", "sha"


def passages(seed, letters):
    """Texts of passages, runs and periods that overlap, over few different words."""
    rng = random.Random(seed)
    word = lambda: rng.choice(letters)
    shared = [" ".join(word() for _ in range(rng.choice([49, 50, 51, 80, 120]))) for _ in range(6)]
    shared += [" ".join(["run"] * 70), " ".join(["ab", "cd", "ef"] * 40), " ".join((["z"] * 7 + ["y"]) * 12)]
    rows = []
    for i in range(50):
        parts = [rng.choice([*shared, " ".join(word() for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(40), rng.choice([" ", "\n", "\t "]).join(parts), "en", "s"))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh"), (3, [f"w{i}" for i in range(5000)])])
def test_repeats(spark, seed, letters):
    rows = passages(seed, letters)
    assert as_rows(repeats.removed(frame(spark, rows)), *REPEAT_COLUMNS) == brute_repeats(rows)


def test_repeats_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "AT_ONCE", 200)
    fifty = " ".join(f"w{i}" for i in range(50))
    long_ = " ".join(f"x{i % 977}" for i in range(3000))
    rows = [(5, fifty, "en", "s"), (3, fifty + " tail", None, None), (3, "head  " + fifty, "en", None), (None, fifty, "en", "s"), (9, None, "en", "s"), (10, "", "en", "s"), (11, " \t", "en", "s")]
    rows += [(20, fifty[:-1], "en", "s"), (21, "É " * 60, "en", "s"), (22, "é " * 60, "en", "s"), (23, "É " * 49, "en", "s"), (24, "É " * 500, "en", "s"), (5, fifty, "en", "s"), (6, fifty, "en", "s"), (30, long_, "en", "s"), (31, "a " + long_ + " b", "en", "s")]
    got = as_rows(repeats.removed(frame(spark, rows)), *REPEAT_COLUMNS)
    assert got == brute_repeats(rows)
    assert repeats.removed(frame(spark, rows).limit(0)).count() == 0


def test_repeats_of_one_hot_passage(spark, monkeypatch):
    """A third of all rows hold one passage, and a third is one row, again and again."""
    monkeypatch.setattr("quillstack.llm.common.HOT_ROWS", 20)
    rng = random.Random(9)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    hot, again = word(55), word(60)
    rows = [(i, f"{word(30)} {hot} {word(30)}", "en", "s") for i in range(150)] + [(1000, again, "en", "s")] * 150 + [(2000 + i, word(80), "en", "s") for i in range(150)]
    assert as_rows(repeats.removed(frame(spark, rows)), *REPEAT_COLUMNS) == brute_repeats(rows)


def test_repeats_of_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = as_rows(QUERIES["op13_repeats"](spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats(rows) and any(r[2] for r in got)


@pytest.mark.parametrize("letters", [2, 5, 1000])
def test_symbols_follow_from_the_words_they_depend_on(letters):
    """Wherever the words from lo to hi occur, in whatever surroundings, the level has the same symbol."""
    rng = np.random.default_rng(letters)
    core = np.concatenate([rng.integers(1, letters + 1, 90), np.full(15, 1), np.tile([1, 2], 12), rng.integers(1, letters + 1, 60)]).astype(np.uint64)
    seen = []
    for left, right in ((3, 8), (0, 40), (25, 0)):
        words = np.concatenate([[0], rng.integers(1, letters + 1, left), core, rng.integers(1, letters + 1, right), [0]]).astype(np.uint64)
        border = np.zeros(len(words), bool)
        border[[0, -1]] = True
        a = 1 + left
        seen.append([{(lo - a, hi - a, s - a, n) for lo, hi, s, n, b in zip(x.lo.tolist(), x.hi.tolist(), x.start.tolist(), x.name.tolist(), x.border) if lo >= a and hi <= a + len(core) and not b} for x in repeats.levels(words, border, 7)])
    for one, two, three in zip(*seen):
        assert {(s, n) for *_, s, n in one} and one == two == three
    assert all(len(x) < len(y) for x, y in zip(seen[0], seen[0][1:]))


def test_field_of_hashes_is_written_by_tasks(spark):
    """The field of op12 does not come to the driver: it is files, and holds each word's bit and no other."""
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("abcdé"), rng.integers(6, 12))) for _ in range(4000)})
    df = spark.createDataFrame([(w, 9) for w in words], "word string, n long").repartition(7)
    bits, (to, parts) = spelling.hash_field(df, len(words))
    assert parts == list(range(spelling.FIELD_PARTS))
    letters, want = spelling._letters_of(), set()
    for w in words:
        codes = np.frombuffer(w.encode("latin-1"), np.uint8)
        h = (letters[codes] * spelling._powers(len(codes))[: len(codes)]).sum(dtype=np.uint64)
        want.add(int(spelling._slots(np.array([h]), bits)[0]))
    field = spelling._field(bits, to, parts)
    got = np.flatnonzero(np.unpackbits(field.view(np.uint8), bitorder="little"))
    assert set(got.tolist()) == want
