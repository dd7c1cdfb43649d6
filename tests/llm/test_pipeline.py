"""The pipeline, stage by stage, against brute force."""

import collections
import itertools
import random

import corpus_pipeline as cp
import pytest
from quillstack.llm import langid, mixing

from .test_operators import brute_targets, count_words, brute_classes, brute_fp, brute_overlap, brute_pack, brute_shingles, library, rows_of  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's rows, written and read again."""
    to = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, out[-1], sf).write.parquet(f"{to}/{i}")
        out.append(spark.read.parquet(f"{to}/{i}"))
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns and d.dtypes == stages[0].dtypes for d in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_language(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    lost = [r for r in stages[0].collect() if r.doc_id not in kept]
    assert len(lost) <= 0.01 * stages[0].count()
    reader = langid.Reader(langid.learn(stages[0]))
    assert all(reader.read(r.text)[1] <= langid.LEAST_SCORE for r in lost)


def test_language_rejects_planted_junk(spark, sf, stages):
    """Junk of letters and texts of other languages go, whatever label they carry; what is clean stays."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    bad = [" ".join(word() for _ in range(120)) for _ in range(20)] + ["Rząd rozważa wprowadzenie nowej ustawy dotyczącej transportu publicznego oraz cen energii w całym kraju", "Правительство рассматривает новый закон", "123 456", "", None]
    planted = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t or "")) for i, t in enumerate(bad)], stages[0].schema)
    kept = {r.doc_id for r in cp.language_id(spark, stages[0].unionByName(planted), sf).collect()}
    assert not [i for i in kept if i >= 10**6]
    assert len(kept) >= 0.99 * stages[0].count()


def test_dedup(stages):
    """Of each class that links at 4 bits or at a similarity of 0.8 connect the smallest id stays, and nothing else."""
    rows = stages[1].orderBy("doc_id").collect()
    kept = {r.doc_id for r in stages[2].collect()}
    assert stages[2].count() == len(kept) and set(map(tuple, stages[2].collect())) <= set(map(tuple, rows))
    fps, sets = {r.doc_id: brute_fp(r.text) for r in rows}, {r.doc_id: brute_shingles(r.text) for r in rows}
    of = dict(zip(sets, brute_classes(list(fps.values()))))
    near = collections.defaultdict(set)
    for i, j in itertools.combinations(sets, 2):
        if of[i] != of[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            near[of[i]].add(of[j])
            near[of[j]].add(of[i])
    root = {}
    for c in set(of.values()):
        todo = [c]
        while todo:
            if (x := todo.pop()) not in root:
                root[x] = c
                todo += near[x]
    assert kept == {min(i for i in sets if root[of[i]] == r) for r in {root[c] for c in of.values()}}


def test_decontamination(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_overlap([(r.doc_id, r.text) for r in stages[2].collect()], items) if r[2]}
    assert hit and rows_of(stages[3], "doc_id") == sorted(((r.doc_id,) for r in stages[2].collect() if r.doc_id not in hit), key=repr)


def test_mixing(stages):
    """Each source is near its target, as near as whole documents allow."""
    sizes, got, copies, squares = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        sizes[r.source] += count_words(r.text)
        squares[r.source] += count_words(r.text) ** 2
    for r in stages[4].collect():
        got[r.source] += count_words(r.text)
        copies[r.doc_id] += 1
    want = brute_targets(sizes)
    assert max(copies.values()) <= 2
    for s in sizes:  # rounding a document's copies is a draw: 3.5 deviations of at most half its size each
        assert abs(got[s] - want[s]) <= 0.01 * want[s] + 3.5 * 0.5 * squares[s] ** 0.5, s
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.1)


def test_output(spark, stages, library):  # noqa: F811
    """The packed files hold the mix in its own order: that of the slots, source beside source."""
    import pyarrow.parquet as pq

    files = sorted(f.removeprefix("file://") for f in stages[4].inputFiles())
    rows = [r for f in files for r in pq.read_table(f, columns=["doc_id", "text", "source"]).to_pylist()]
    assert rows_of(stages[5], "*") == sorted(brute_pack([(r["doc_id"], r["text"]) for r in rows], library), key=repr)
    slot = {r.doc_id: r.first_slot for r in mixing.mix(stages[3]).collect()}
    firsts = [slot[i] for i in dict.fromkeys(r["doc_id"] for r in rows)]
    assert firsts == sorted(firsts)
    assert len({r["source"] for r in rows[: len(rows) // 4]}) == len({r["source"] for r in rows})


def test_run(spark, sf, stages):
    assert rows_of(cp.run(spark, sf), "*") == rows_of(stages[-1], "*")


def test_empty_and_repeated(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, f in cp.STAGES:
        docs = f(spark, docs, sf)
    assert docs.count() == 0
    few = stages[0].orderBy("doc_id").limit(20)
    twice = few.unionByName(few).unionByName(few.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars"))
    assert rows_of(cp.near_dedup(spark, twice, sf), "*") == rows_of(cp.near_dedup(spark, few, sf), "*")
