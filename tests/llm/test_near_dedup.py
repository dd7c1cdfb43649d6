"""Near-dedup of templates: the same classes as brute force, and join rows in proportion to the texts."""

import itertools
import random

import pytest

from quillstack.llm import simhash

from .test_operators import brute_classes, brute_fp, brute_shingles


def family(n, own, seed=0):
    """Texts of one template, each with some words of its own in its midst."""
    rng = random.Random(seed + n)
    t = [f"t{i}" for i in range(100)]
    return [(i, " ".join(t[:40] + [f"o{i}x{j}" for j in range(rng.randint(*own))] + t[40:])) for i in range(n)]


def brute(rows):
    """The smallest id of each class of links at 4 bits, or at 0.8."""
    of = brute_classes([brute_fp(t) for _, t in rows])
    root = {c: c for c in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [brute_shingles(t) for _, t in rows]
    for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2):
        if len(x & y) >= 0.8 * len(x | y) and find(of[a]) != find(of[b]):
            root[find(of[a])] = find(of[b])
    low = {}
    for (i, _), c in zip(rows, of):
        low[find(c)] = min(low.get(find(c), i), i)
    return sorted(low.values())


def join_rows(spark, after):
    """(last execution, rows that joins made) of executions after a number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total, last = store.executionsList(), 0, after
    for k in range(runs.size()):
        at = runs.apply(k).executionId()
        if at <= after:
            continue
        last, said = max(last, at), store.executionMetrics(at)
        nodes = store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size() if "Join" in node.name() else 0):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and said.contains(m.accumulatorId()):
                    total += int(said.apply(m.accumulatorId()).replace(",", ""))
    return last, total


@pytest.mark.parametrize("own", [(12, 12), (2, 14)])
def test_a_template_makes_rows_in_proportion(spark, own):
    made, last = [], join_rows(spark, -1)[0]
    for n in (250, 500, 1000):
        docs = spark.createDataFrame(family(n, own), "doc_id long, text string")
        simhash.without_copies(docs, similar=True).count()
        last, rows = join_rows(spark, last)
        made.append(rows / n)
    # Rows of a text, and not the square: four times the texts are four times the rows, about.
    assert made[0] > 0 and made[2] <= 2 * max(made[0], made[1] / 1.2)


@pytest.mark.parametrize("own,centres", [((12, 14), 3), ((2, 14), 0), ((0, 30), 3)])
def test_template_classes(spark, monkeypatch, own, centres):
    """Similar or not, whatever is compared first: classes are those of all pairs."""
    monkeypatch.setattr(simhash, "CENTRES", centres)
    monkeypatch.setattr(simhash, "CROWDED", 0)
    rows = family(70, own) + [(1000 + i, t) for i, t in family(20, (1, 3), 5)] + [(2000, ""), (2001, None), (2002, family(70, own)[3][1])]
    kept = sorted(r.doc_id for r in simhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string"), similar=True).collect())
    assert kept == brute([(i, t or "") for i, t in rows])


def test_decontamination_takes_texts_in_pieces(monkeypatch):
    """What `find` needs beside a shard's texts does not grow with the shard, and pieces change nothing."""
    import random
    import tracemalloc

    from quillstack.llm import decontam

    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(rng.choices(words, k=30))
    phrases = decontam.Phrases([("a", item.encode()), ("b", b"alone"), ("c", b"w1 w2 w3")])
    texts = [" ".join(rng.choices(words, k=20_000)).encode() for _ in range(100)] + [None, b""]
    texts[17] += b" " + item.encode()
    texts[42] = b"alone " + texts[42] + b" " + " ".join(item.split()[3:17]).encode()
    tracemalloc.start()
    some = decontam.find(texts, phrases)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * sum(len(t) for t in texts if t)
    monkeypatch.setattr(decontam, "PIECE_BYTES", 1 << 60)
    for a, b in zip(some, decontam.find(texts, phrases)):
        assert (a == b).all()
    assert len(set(some[1][:, 0].tolist())) >= 2


def test_freed_memory_goes_back():
    """What a task has freed is not kept by its worker, for tasks of the stages behind it run beside it."""
    import subprocess
    import sys

    code = """
from quillstack.llm.common import give_back
import ctypes
def mb(): return int(open("/proc/self/statm").read().split()[1]) * 4 // 1024
give_back()
base, held = mb(), [bytes(2000) for _ in range(150_000)]
last, top = bytes(2000), mb()
del held
give_back()
print(top - base, mb() - base)
"""
    top, left = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert top > 200 and left < 60
