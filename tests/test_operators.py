"""Hand-checked cases of the operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators import citations as C
from quillstack.operators import judge as J
from quillstack.operators import lexical as L
from quillstack.operators import vector as V
from quillstack.streaming import events as S


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("f, value, want", [
    (T.fold, "ŁĄCZNIK", "LACZNIK"), (T.fold, "ǖ é", "u e"),
    (T.noun_phrase, "Ile kosztuje wkładka antywłamaniowa?", "wkładka antywłamaniowa"), (T.noun_phrase, "dzielony wał", ""),
    (T.noun_phrase, "show me the door", "the door"), (T.query_variants, " dzielony wał ", ["dzielony wał"]),
    (T.query_variants, "Pokaż próg", ["Pokaż próg", "próg"]),
    (T.revision, "nagłówek 01.01.2020 stopka CBG/PL-PLN/10.04.2025", "2025-04-10"), (T.revision, "x 01.02.2020", "2020-02-01"), (T.revision, "nic", None),
    (T.tokenise, "Pokaż bramy roletowe i A-1 RC2", ["bram", "rolet", "rc2"]), (T.tokenise, "", []),
])
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_stems_meet(spark):
    assert len({one(spark, T.stem, w) for w in ("roletowe", "roletowa", "roletowych")}) == 1
    assert [one(spark, T.stem, w) for w in ("okno", "12345", "wal")] == ["okno", "12345", "wal"]


def test_bm25_counts_empty_documents_and_repeats(spark):
    docs = spark.createDataFrame([(1, "brama rolet brama"), (2, ""), (3, "klamka")], "doc_id long, text string")
    post = L.postings(docs)
    s = L.corpus_stats(post).first()
    assert (s["n"], s["avglen"]) == (3, pytest.approx(4 / 3))
    once = spark.createDataFrame([(1, "brama")], "i long, t string")
    twice = spark.createDataFrame([(1, "brama brama")], "i long, t string")
    a, b = (L.scores(post, L.query_terms(q, "i", "t")).first()["score"] for q in (once, twice))
    assert b == pytest.approx(2 * a)


def hits(spark, rows):
    return spark.createDataFrame(rows, "q long, page long, chunk int, scale string, score double, rank int")


def test_page_scores(spark):
    got = {r.page: r for r in V.page_scores(hits(spark, [(1, 1, 2, "region", 0.5, 1), (1, 1, 3, "region", 0.4, 2), (1, 2, 0, "page", 0.9, 3), (1, 2, 2, "region", 0.4, 4)])).collect()}
    assert got[1].score == pytest.approx(0.572) and got[2].focus == 2


def test_fuse_ties_keep_the_first_variant(spark):
    pages = spark.createDataFrame([(1, 0, 7, 0.8, 1), (1, 1, 7, 0.4, 1), (1, 1, 8, 0.2, 2)], "q long, variant long, page long, score double, first int")
    got = {r.page: r for r in V.fuse(pages).collect()}
    assert got[7].variant == 0 and got[7].norm == 1 and got[8].norm == 0.5
    down = spark.createDataFrame([(1, 0, 1, -0.1, 1), (1, 0, 2, -0.2, 2)], "q long, variant long, page long, score double, first int")
    assert [r.page for r in V.fuse(down).orderBy("rank").collect()] == [2, 1]  # a negative best turns the order round


def test_rrf(spark):
    rows = spark.createDataFrame([(1, 0, "visual", 10, 1, 1.0), (1, 0, "visual", 11, 2, 1.0), (1, 1, "lexical", 11, 1, 1.0)], "q long, list int, source string, page long, rank int, weight double")
    first = V.rrf(rows).orderBy("rank").first()
    assert first.page == 11 and first.rrf == pytest.approx(1 / 62 + 1 / 61) and first.sources == ["lexical", "visual"]


def greedy(costs, budget):
    """Shards of costs in their order, one after the other."""
    out, shard, size = [], 0, 0
    for i, c in enumerate(costs):
        if i and size and size + c > budget:
            shard, size = shard + 1, 0
        size += c
        out.append(shard)
    return out


@pytest.mark.parametrize("fold_rows", [0, 10**6])
def test_shard_plan(spark, fold_rows):
    from quillstack.operators import shards

    rng = random.Random(4)
    costs = {"a": [1000] * 10, "b": [99999, 1, 1, 2000, 1], "hot": [rng.choice([1, 40, 700, 1999, 2000, 2001, 5000]) for _ in range(1500)], None: [600] * 7}
    rows = [(g, i, c) for g, cs in costs.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    got = shards.plan(spark.createDataFrame(rows, "g string, i long, cost long"), "g", "i", 2000, fold_rows).collect()
    for g, cs in costs.items():
        assert [r.shard for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == greedy(cs, 2000)
    assert shards.plan(spark.createDataFrame([], "g string, i long, cost long"), "g", "i", 2000, fold_rows).count() == 0


def test_a_group_that_holds_all_rows_is_cut_in_several_tasks(spark):
    from quillstack.operators import shards
    from quillstack.operators.ordinal import with_running

    rows = spark.range(4000).select(F.lit("one").alias("g"), F.col("id").alias("i"), (F.col("id") % 90 + 1).alias("cost"))
    placed = with_running(rows, ["g"], ["i"], {"end": F.col("cost"), "at": F.lit(1)}, parts=8)
    tasks = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 4000
    got = {r.i: r.shard for r in shards.plan(rows, "g", "i", 1000, fold_rows=0).collect()}
    assert [got[i] for i in range(4000)] == greedy([i % 90 + 1 for i in range(4000)], 1000)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_sums(spark, group):
    from quillstack.operators.ordinal import with_running

    rows = [(i, i % 2, None if i % 7 == 0 else i) for i in range(500)]
    got = with_running(spark.createDataFrame(rows, "i long, g int, v long"), group, ["i"], {"s": F.col("v"), "n": F.lit(1)}, parts=5).collect()
    for r in got:
        mine = [x for x in rows if not group or x[1] == r.g]
        assert (r.s, r.s_of) == (sum(x[2] or 0 for x in mine if x[0] <= r.i), sum(x[2] or 0 for x in mine)) and r.n_of == len(mine) and r.n == sum(x[0] <= r.i for x in mine)


@pytest.mark.parametrize("bad", [float("nan"), -1.0, 4.0])
def test_an_invalid_score_puts_the_order_back(spark, bad):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, bad), (2, 1, 1.0), (2, 2, 3.0), (2, 3, None)], "q long, ord int, raw double")
    got = sorted((r.q, r["rank"], r.ord) for r in J.rerank(rows, 10).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]


def test_verdict(spark):
    rows = [(0.05, 0.01), (0.9, 0.01), (None, None), (0.9, 0.4)]
    got = spark.createDataFrame(rows, "s double, a double").select(J.verdict(F.col("s"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["out-of-scope", "not-in-corpus", "ok", "ok"]


def test_overlap_judge(spark):
    pairs = spark.createDataFrame([("brama rolet", "bramy stalowe"), ("brama", " ")], "query string, text string")
    assert [r.raw for r in J.OverlapJudge().score(pairs).collect()] == [1.5, None]


def test_best_run():
    page = "ala ma wyko nane drzwi 2500".split()
    assert C.best_run(page, ["ma", "wykonane", "drzwi"]) == (1, 5, 3)
    assert C.best_run(page, ["inne", "wykonane"]) == (0, 0, 0)
    assert C.best_run(page, ["zły", "drzwi"])[2] == 0 and C.best_run([], ["a"]) == (0, 0, 0)


def test_figures():
    assert C.figures("3 956 zł, 2500x2100 mm, 2500; 12; 1234567") == ["3956", "2500", "2100"]
    # The second stands on two lines.
    assert C.figure_spans(["3", "956", "3", "956"], [0, 0, 1, 2], "3956") == [(0, 2)]


def test_best_run_reads_fragments_and_passes_over_some():
    assert C.best_run("x a wyko nane b".split(), ["a", "wykonane"]) == (1, 4, 2)
    assert C.best_run("x a wyko na b".split(), ["a", "wykonane"])[2] == 1
    assert C.best_run("a wyko nane b".split(), ["wykonane"]) == (0, 0, 0)  # no token is the first one's
    assert C.best_run("x a q q b c".split(), "a b c".split()) == (1, 6, 3)  # two may be passed over
    assert C.best_run("x a q q q q b c a b".split(), "a b c".split()) == (8, 10, 2)
    assert C.best_run("najdluzszy b".split(), "a najdluzszy b".split()) == (0, 0, 0)  # it would begin before the page


def test_citations_resolve(spark):
    """A quote that isn't there stays; a named article never falls to another; figures hang on a page's first citation."""
    words = lambda text: [(float(i % 4 * 10), float(i // 4 * 10), float(i % 4 * 10 + 8), float(i // 4 * 10 + 5), t, i // 4) for i, t in enumerate(text.split())]
    pages = spark.createDataFrame([("p", words("cena drzwi 3 956 wynosi 2500 albo 2500")), ("q", words("inne drzwi wykonane z drewna")), ("blank", [])], f"document string, words {C.WORDS}")
    attached = spark.createDataFrame([(1, 0, 61, 1, "p"), (1, 1, 61, 2, "q"), (1, 0, 7, 3, "blank")], "id long, article long, page long, rank int, document string")
    answers = spark.createDataFrame([(1, "Cena to 3 956 / 2500 / 777")], "id long, answer string")
    cites = [(1, 1, 61, None, "cena drzwi"), (1, 2, 61, 1, "wykonane z drewna"), (1, 3, 61, 0, "tego nie ma"), (1, 4, 61, 5, "cena drzwi"), (1, 5, 99, None, "x"), (1, 6, 7, 0, "cena drzwi")]
    cites = spark.createDataFrame([(*c, c[-1].split()) for c in cites], "id long, ord int, page long, article long, quote string, tokens array<string>")
    got = {r.ord: r for r in C.resolve(cites, attached, answers, pages).collect()}
    assert {o: (r.document, r.verified, r.coverage, r.text_layer) for o, r in got.items()} == {1: ("p", True, 1.0, True), 2: ("q", True, 1.0, True), 3: ("p", False, 0.0, True), 6: ("blank", False, 0.0, False)}
    assert [tuple(r.box) for r in got[1].rects] == [(0.0, 0.0, 18.0, 5.0)] and got[3].rects == []
    assert [(n.value, tuple(n.box)) for n in got[1].numbers] == [("3956", (20.0, 0.0, 18.0, 5.0))] and [(x["value"], x["count"]) for x in got[1].repeated] == [("2500", 2)]
    assert got[2].numbers == got[3].numbers == []


def test_stream_holds_the_marker_back(spark, tmp_path):
    deltas = [(1, 0, "abc---CY"), (1, 1, "TATY---{}"), (2, 0, "no marker at all")]
    assert {r.k: r.answer for r in S.fold_deltas(spark.createDataFrame(deltas, "k long, i int, t string"), "k", "i", "t").collect()} == {1: "abc", 2: "no marker at all"}
    for i, d in enumerate(deltas):
        spark.createDataFrame([d], "k long, i int, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)  # files come in order of time
    stream = spark.readStream.schema("k long, i int, t string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.stream_deltas(stream, "k", "t").writeStream.format("memory").queryName("deltas").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    shown = {r.k: r.s for r in spark.sql("select k, array_join(collect_list(shown), '') as s from deltas group by k").collect()}
    assert shown == {1: "abc", 2: "no marker at all"}


def test_stream_shows_the_tail_at_the_end_and_forgets(spark, tmp_path):
    schema = "k long, i int, t string, e boolean"
    batches = [[(1, 1, "---CY", False), (1, 0, "abc", False), (2, 0, "x--", False)], [(1, 2, None, False), (2, 1, None, True)], [(1, 3, "no marker", True), (2, 0, "again", True)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.stream_deltas(stream, "k", "t", "i", "e").writeStream.format("memory").queryName("tails").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    shown = {r.k: r.s for r in spark.sql("select k, collect_list(shown) as s from tails group by k").collect()}
    assert shown == {1: ["abc", "", "---CYno marker"], 2: ["x", "--", "again"]}


def test_windows_on_a_stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/ev")
    q = S.windowed(stream, "1 hour", "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == batch.count()


def test_ordinals_are_a_global_order(spark):
    from quillstack.operators.ordinal import with_ordinal

    rows, n = with_ordinal(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(6), ["v"], parts=7)
    got = [(r.v, r.ordinal) for r in rows.collect()]
    assert n == 5000 and [o for _, o in sorted(got)] == list(range(5000))
    assert with_ordinal(spark.range(0), ["id"])[1] == 0


def test_expansion_keeps_the_question_first(spark):
    class Says(J.OverlapJudge):
        def __init__(self, raw):
            self.raw = raw

        def score(self, pairs):
            return pairs.withColumn("raw", self.raw)

    facets = ["price", "size", "colour"]
    q = spark.createDataFrame([(1, "Ile kosztuje brama?")], "q long, query string")
    variants = lambda raw: [r.variant for r in J.expand(q, facets, Says(raw)).orderBy("ord").collect()]
    assert variants(F.when(F.col("query") == "price", 2.7).otherwise(0.3)) == ["Ile kosztuje brama?", "brama", "brama price"]
    assert variants(F.lit(3.0)) == ["Ile kosztuje brama?", "brama", "brama price", "brama size"]
    for bad in (float("nan"), -1.0, 4.0, None):
        assert variants(F.when(F.col("query") == "size", F.lit(bad).cast("double")).otherwise(3.0)) == ["Ile kosztuje brama?", "brama"]
    assert [r.variant for r in J.expand(q, ["brama kosztuje", "okno"]).orderBy("ord").collect()] == ["Ile kosztuje brama?", "brama", "brama brama kosztuje"]


def test_pages_without_a_score_keep_their_order_behind(spark):
    rows = [(1, 1, None), (1, 2, 0.3), (1, 3, 3.0), (1, 4, None), (1, 5, 0.3)]
    got = J.order_pages(spark.createDataFrame(rows, "q long, prior int, raw double")).orderBy("rank").collect()
    assert [r.prior for r in got] == [3, 2, 5, 1, 4] and got[0].score == 1 and got[3].score is None


def test_gate_and_fold(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.3), (2, 0.0)], "q long, raw double")
    scope = spark.createDataFrame([(1, 0.8), (2, 0.9), (3, 0.05)], "q long, scope double")
    assert {r.q: r.verdict for r in J.gate(scored, scope).collect()} == {1: "ok", 2: "not-in-corpus", 3: "out-of-scope"}
    sweep = spark.createDataFrame([(1, i, 2.7 if i == 3 else 0.15) for i in range(8)], "q long, key long, raw double")
    shards = spark.createDataFrame([(i, i // 2) for i in range(8)], "key long, shard long")
    assert [tuple(r) for r in J.fold_shards(sweep, shards).collect()] == [(1, 0.9, 4)]


def test_sweep_is_what_scoring_all_pairs_gives(spark):
    q = spark.createDataFrame([(1, "brama rolet"), (2, "okno"), (3, "")], "q long, query string")
    p = spark.createDataFrame([(7, "bramy stalowe"), (8, "rolety i bramy"), (9, " "), (10, None)], "key long, text string")
    judge = J.OverlapJudge()
    want = {(r.q, r.key): r.raw for r in judge.score(q.crossJoin(p)).collect() if r.raw}
    assert {(r.q, r.key): r.raw for r in judge.sweep(q, p).collect()} == want and want[1, 8] == 3


def test_sidecar_and_upsert(spark):
    from quillstack.operators import sidecar

    pages = spark.createDataFrame([("a", 1, "x" * 19 + " \n"), ("a", 2, "x" * 20), ("a", 3, None), ("b", 1, "nagłówek 01.01.2020 stopka CBG/PL-PLN/10.04.2025")], "t string, p int, x string")
    side = sidecar.build(pages, "t", "p", "x")
    assert [r.visual_only for r in side.orderBy("title", "page").collect()] == [True, False, True, False]
    assert {r.title: (r.pages, r.visual_only, r.revisions, r.newest) for r in sidecar.report(side).collect()} == {"a": (3, 2, 0, None), "b": (1, 0, 1, "2025-04-10")}
    old, new = (spark.createDataFrame(x, "n long, text string") for x in ([(1, "a"), (2, "b")], [(2, "new"), (3, None)]))
    assert {r.n: r.text for r in sidecar.upsert(old, new, "n").collect()} == {1: "a", 2: "new", 3: None}


def test_blocks_of_queries_give_what_a_broadcast_does(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(300)
    q = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    few, many = (V.inner_products(e, q, n) for n in (4096, 10))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ordinals_in_groups(spark):
    from quillstack.operators.ordinal import nearest_rank, with_group_ordinal

    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise("b")).alias("g"))
    got = with_group_ordinal(rows, ["g"], ["v"], parts=7).collect()
    for g in ("hot", "b", None):
        mine = sorted((r.v, r.ordinal) for r in got if r.g == g)
        assert [o for _, o in mine] == list(range(len(mine))) and {r.ordinal_of for r in got if r.g == g} == {len(mine)}
    of = lambda p, n: spark.range(1).select(nearest_rank(p, F.lit(n))).first()[0]
    assert [of(p, n) for p, n in ((50, 1), (50, 5), (95, 20), (99, 150), (50, 7))] == [max(0, round(p / 100 * n) - 1) for p, n in ((50, 1), (50, 5), (95, 20), (99, 150), (50, 7))]


def test_containing(spark):
    from quillstack.operators.contain import containing

    pages = [(1, "Ala ma kota i psa"), (2, "ma kota"), (3, "bala MA kota"), (4, None), (5, "")]
    items = [(1, "la ma kota"), (2, "kot"), (3, "ma psa kota"), (4, ""), (5, None), (6, "ala  ma"), (7, "a ma kota i p")]
    got = containing(spark.createDataFrame(pages, "key long, text string"), spark.createDataFrame(items, "item long, s string"))
    want = sorted((i, k) for i, s in items for k, t in pages if s is not None and t is not None and s.lower() in t.lower())
    assert sorted(map(tuple, got.collect())) == want


def test_cache(spark):
    from quillstack.operators import cache

    schema = "namespace string, entry long, embedding array<double>, created long, last_used long"
    e = spark.createDataFrame([("a", 1, [1.0, 0.0], 10, None), ("a", 2, [0.0, 1.0], 20, None), ("b", 3, [0.9, 0.436], 5, 30)], schema)
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.8, 0.6]), (3, "c", [1.0, 0.0]), (4, "b", [1.0, 0.0])], "probe long, namespace string, embedding array<double>")
    for most in (4096, 0):
        got = {r.probe: (r.entry, r.served) for r in cache.lookup(e, p, max_probes=most).collect()}
        assert got == {1: (1, True), 2: (1, False), 4: (3, False)}  # a near one of another namespace can't win
    ties = spark.createDataFrame([("a", i, [1.0, 0.0], 7, None) for i in range(5)], schema)
    assert sorted(r.entry for r in cache.kept(ties, 3).collect()) == [0, 1, 2]
    new = spark.createDataFrame([("a", 9, [1.0, 1.0], 40, None), ("a", 10, [0.0, 0.0], 50, None)], schema)
    assert sorted(r.entry for r in cache.put(e, new, 3).collect()) == [2, 3, 9]
    wide = spark.createDataFrame([("a", 11, [1.0, 1.0, 0.0], 60, None)], schema)
    assert [r.entry for r in cache.put(e, wide).collect()] == [11]
    key = lambda *x: spark.range(1).select(cache.namespace_key(*x)).first()[0]
    assert key("p", "m", "one", "hybrid", 4, "j", "f") == "p|m|one|ret:hybrid|k4|j|f" != key("p", "m", "one", "visual", 4, "j", "f")


def test_router(spark):
    from quillstack.operators import router as R

    none, full, off, manual = (False, None, False, True), (True, "on", True, True), (True, "off", True, True), (True, "manual", False, False)
    rows = spark.createDataFrame([(i, w, *s) for i, (w, s) in enumerate([(None, none), (" AUTO ", full), ("Xray", none), ("best", full), ("", off), ("default", manual), ("jev", off), ("xray", manual), ("hybrid", manual)])], f"i int, wish string, {R.SETTING}")
    got = {r.i: (r.mode, r.hindrance) for r in R.resolved(rows).collect()}
    assert got == {0: ("visual", None), 1: ("jev-page", None), 2: ("xray", "judge: no key"), 3: ("best", "unknown: best"), 4: ("hybrid", None), 5: ("visual", None), 6: ("jev", "judge: off"), 7: ("xray", "pages: no texts"), 8: ("hybrid", "pages: no texts")}
    listed = R.offered(spark.createDataFrame([full], R.SETTING)).orderBy("place").collect()
    assert [r.mode for r in listed] == [m for m, *_ in R.MODES] and [r.mode for r in listed if r.usual] == ["jev-page"] and not any(r.hindrance for r in listed)
    pages = lambda n, crops: spark.createDataFrame([(1, p, p) for p in range(1, crops + 1)], "q int, page int, rank int")
    assert [tuple(r) for r in R.run(spark, None, none, {"visual": pages}, 5).orderBy("rank").collect()] == [("visual", 1, p, p) for p in range(1, 6)]
    assert (R.crops_wanted(2), R.crops_wanted(9), R.crops_wanted(9, 3)) == (24, 54, 3)
    with pytest.raises(R.Hindered):
        R.run(spark, "jev", none, {"jev": pages})
    assert {r.mode for r in R.run_all(spark, none, dict.fromkeys([m for m, *_ in R.MODES], pages)).collect()} == {"visual", "hybrid"}


def test_question_sets_are_read_back(spark, tmp_path):
    from quillstack.sources import questions

    rows = [('Co to jest "brama"?', "spec", "Cennik\\2025", [1, 2], 1, True), ("line\nbreak: [x]", "price", "b", [], None, False), ("\\n stays", "spec", "c: d", [12], 12, True)]
    df = spark.createDataFrame(rows, questions.SCHEMA)
    questions.write(df, f"{tmp_path}/q")
    assert sorted(map(tuple, questions.read(spark, f"{tmp_path}/q").drop("oracle").collect())) == sorted(rows)
    (tmp_path / "hand.yaml").write_text('# comment\n- q: "one"\n  doc: "d"\n\n- q: "two"\n  kind: price\n  doc: "e"\n  pages: [3]\n  answerable: false\n')
    assert sorted(map(tuple, questions.read(spark, f"{tmp_path}/hand.yaml").drop("oracle").collect())) == [("one", "spec", "d", [], None, True), ("two", "price", "e", [3], None, False)]


def test_layout(spark):
    from quillstack.sources import layout

    paths = spark.createDataFrame([("t/2.png.tiles",), ("t/10.png.tiles",), ("t/x.png.tiles",), ("t/3.json",)], "path string")
    assert [(r.article_id, r.path) for r in layout.tile_listing(paths).orderBy("article_id").collect()] == [(-1, "t/x.png.tiles"), (2, "t/2.png.tiles"), (10, "t/10.png.tiles")]
    rows, names = spark.createDataFrame([(0,), (7,)], "article_id int"), spark.createDataFrame([(0, "a")], "article_id int, title string")
    assert {r.article_id: r.title for r in layout.with_titles(rows, names).collect()} == {0: "a", 7: "?"}
    urls = spark.createDataFrame([("p\\a.PDF",), ("http://x/y",), (None,)], "u string").select(layout.source_pdf(F.col("u")).alias("p"), layout.page_image(F.lit(3), F.lit(12)).alias("i")).collect()
    assert [r.p for r in urls] == ["p/a.PDF", None, None] and urls[0].i == "tiles/3.png.tiles/tile_0012.jpg"
    ink = spark.createDataFrame([(1, 0.0049), (2, 0.005), (3, None)], "i int, ink double")
    assert [r.i for r in layout.without_blanks(ink).collect()] == [2, 3]
    v = spark.range(200).selectExpr("id % 2 * id as g")
    assert {r.g: r.lists for r in layout.index_plan(v, ["g"]).where("g < 2").collect()} == {0: 2, 1: 1}


def test_question_provenance_is_read_back(spark, tmp_path):
    from quillstack.sources import questions

    rows = [("a", "spec", None, [1], 1, True, (0.75, None, 1.0, 2, 'x, best: "9" from: y')), (None, "price", "", [], None, False, None), ("b", "spec", "d", [], None, True, (None, 0.5, None, None, None))]
    df = spark.createDataFrame(rows, f"{questions.SCHEMA}, oracle {questions.ORACLE}")
    questions.write(df, f"{tmp_path}/q")
    assert sorted(map(tuple, questions.read(spark, f"{tmp_path}/q").collect()), key=repr) == sorted(rows, key=repr)
    said = "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/q").collect())
    assert said.count(questions.HEADER) == 1 and '  doc: null\n' in said


def test_sources_sizes_and_keys(spark):
    from quillstack.operators import sidecar
    from quillstack.sources import layout

    rows = spark.createDataFrame([(0, 0, "a.pdf"), (1, 0, "b.pdf"), (2, 1, None)], "article_id int, tile int, pdf string")
    there = layout.existing(rows, spark.createDataFrame([("a.pdf",), ("a.pdf",)], "path string"))
    assert sorted(map(tuple, there.select("article_id", "pdf").collect())) == [(0, "a.pdf"), (1, None), (2, None)]
    sizes = spark.createDataFrame([(0, 0, 1654, 2339)], "article_id int, tile int, page_width int, page_height int")
    assert sorted((r.article_id, r.page_width, r.page_height) for r in layout.with_sizes(rows, sizes).collect()) == [(0, 1654, 2339), (1, 0, 0), (2, 0, 0)]
    key = lambda q: spark.range(1).select(layout.image_fit_key(F.lit("p"), F.lit(5), F.lit(7), F.lit(layout.fit_policy("n", "tiles", 0, True)), quality=q)).first()[0]
    import hashlib

    assert key(90) == hashlib.sha256(b"p|5|7|n|tiles|0|1|0.85|90").hexdigest()[:20] and key(80) != key(90)
    report = spark.createDataFrame([("a", 2), ("b", 1)], "title string, pages long")
    chunks = spark.createDataFrame([("a", 3, None), ("a", 4, 2)], "title string, num_chunks long, blank_skipped long")
    assert sorted((r.title, r.chunks, r.blanks) for r in sidecar.with_chunks(report, chunks).collect()) == [("a", 7, 2), ("b", 0, 0)]


def test_drift_of_a_rubric_turned_round(spark):
    class Fixed:
        def __init__(self, scores):
            self.scores = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))

        def score(self, pairs):
            return pairs.withColumn("raw", self.scores[F.col("key")])

    pairs = spark.createDataFrame([(1, "x", k, k, "t") for k in range(5)], "q long, query string, key long, ord long, text string")
    got = J.order_drift(pairs, Fixed({0: 3.0, 1: 2.0, 2: 1.0, 3: 0.5, 4: float("nan")}), Fixed({0: 0.0, 1: 0.5, 2: 2.5, 3: 2.0, 4: 0.0})).first()
    assert (got.n, got.mean_drift, got.max_drift, got.top1_stable, got.top3_stable) == (4, 0.375, 0.5, True, False)


def test_crops_of_a_page(spark):
    text = " ".join(f"w{i}" for i in range(500))
    pages = spark.createDataFrame([(1, text), (2, "short page"), (3, None), (4, "x" * 9000)], "key long, text string")
    got = {(r.key, r.crop): r.text for r in J.crop_texts(pages).collect()}
    words = text.split(" ")
    assert {c: t.split(" ") for (k, c), t in got.items() if k == 1} == {i: words[128 * i : 128 * i + 205] for i in range(4)} and got[1, 3].endswith("w499")
    assert got[2, 0] == "short page" and got[3, 0] == "" and got[4, 0] == "x" * 6000
    scored = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, None), (2, 1, 0.5), (3, 0, 3.0), (3, 1, float("nan"))], "key long, crop int, raw double")
    assert {r.key: r.crop for r in J.best_crops(scored, ["key"]).collect()} == {1: 1, 2: 1, 3: 1}


def test_best_documents_are_those_of_all_scores(spark, monkeypatch):
    from quillstack.operators import lexical as L

    texts = ["brama rolety", "bramy stalowe bramami rolet", "okno", "", None, "Łódź, żółte okna 2500 i okno", "co to jest brama", "ab a brama brama brama"]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(100)] + [(None, "bramy"), (200, "stalowej bramy")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([((1, 0), "bramy stalowe brama"), ((1, 1), "lodz okno 2500"), ((2, 0), "nic"), ((3, 0), None)], "k struct<q:long,variant:int>, text string")
    terms = L.query_terms(asked, "k", "text")
    rows = lambda df: sorted(((tuple(r.q), r["rank"], r.doc, round(r.score, 7)) for r in df.collect()), key=str)
    want = rows(L.top(L.score_queries(docs, terms), 5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(L.best(docs, terms, 5)) == want and len(want) == 10
        hit = L.counted(docs, terms.select("term").union(spark.createDataFrame([("zolt",), ("nikogo",)], "term string")))
        assert rows(L.best(docs, terms, 5, hit=hit)) == want
        assert {r.term for r in hit.known().collect()} >= {"zolt", "bram"} and not {r.term for r in hit.known().collect()} & {"nikogo", "nic"}
        for limit in ("FORM_TERMS", "TOLD_PAIRS"):
            with monkeypatch.context() as m:
                m.setattr(L, limit, 2)
                assert rows(L.best(docs, terms, 5)) == want
        assert not L.best(docs, terms.limit(0), 5).count() and not L.best(docs.limit(0), terms, 5).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_hands_on_a_few_documents_of_each_query(spark):
    import pyarrow as pa
    from types import SimpleNamespace

    from quillstack.operators import lexical as L

    n = 3000  # copies that all hold the term
    batch = pa.RecordBatch.from_arrays([pa.array(range(n, 0, -1)), pa.array([5] * n), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array([[2]] * n, pa.list_(pa.int32()))], names=["doc", "dl", "ids", "tfs"])
    (out,) = L._scorer(SimpleNamespace(value=[(0, 0, 1.5), (1, 0, 3.0)]), 2, 5.0, 4)(iter([batch]))
    assert sorted(zip(out["no"].to_pylist(), out["doc"].to_pylist())) == [(q, d) for q in (0, 1) for d in (1, 2, 3, 4)]


def test_words_that_a_term_is_the_stem_of(spark):
    from quillstack.functions import text as T

    words = spark.createDataFrame([(w,) for w in "bramy bramami brama bram okno okna iach 2500 domowego stalowymi stalowa abce abcdee zyciach".split()], "w string")
    got = words.select("w", T.stem(F.col("w")).alias("t")).select("w", "t", T.stem_sources(F.col("t")).alias("all")).collect()
    assert all(r.w in r["all"] and len(set(r["all"])) == len(r["all"]) for r in got)
    back = words.select(F.explode(T.stem_sources(F.col("w"))).alias("s"), "w").where(T.stem(F.col("s")) != F.col("w"))
    assert not back.count()
