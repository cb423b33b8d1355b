import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions import vectors as vx
from rankloom.functions.stats import exact_sign_p, wilson
from rankloom.operators import classify, corpus, dense, fusion, hybrid, intervals, lexical, metrics, rerank
from rankloom.operators.prefix import running


def lists(spark, rel, query=1):
    return spark.createDataFrame([("s", query, i + 1, bool(r)) for i, r in enumerate(rel)], "strategy string, query_id int, rank int, rel boolean")


def test_metrics_by_hand(spark):
    m = metrics.query_metrics(lists(spark, [0, 1, 1, 0]), ["strategy", "query_id"]).first()
    assert (m.first_rank, m.hit_at_1, m.hit_at_3, m.rr) == (2, 0, 1, 0.5)
    assert m.ndcg == pytest.approx(0.693426, abs=1e-6)
    m = metrics.query_metrics(lists(spark, [0] * 11 + [1]), ["strategy", "query_id"]).first()
    assert (m.first_rank, m.hit_at_10, m.rr, m.ndcg) == (12, 0, 0.0, 0.0)


def test_empty_lists_count_as_zero(spark):
    m = metrics.query_metrics(lists(spark, [1]), ["strategy", "query_id"])
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    agg = metrics.aggregate_metrics(metrics.keep_empty(m, q, ["s", "t"]), ["strategy"])
    got = {r.strategy: (r.n, r.hit_at_1) for r in agg.collect()}
    assert got == {"s": (2, 0.5), "t": (2, 0.0)}


@pytest.mark.parametrize("rows", [None, 10])
def test_percentiles(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0)] * 3, "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in metrics.nearest_rank_percentiles(df, ["k"], "v", source_rows=rows).collect()}
    assert got == {"a": (4, 2.0, 4.0), "b": (3, 5.0, 5.0)}
    low = {r.k: (r.p50_index, r.p95_index, r.median) for r in metrics.lower_index_percentiles(df, ["k"], "v", rows).collect()}
    assert low == {"a": (3.0, 4.0, 2.5), "b": (5.0, 5.0, 5.0)}


def test_running_is_the_same_when_spread(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    args = (["g"], [F.col("pos").desc()], {"total": F.col("v")})
    small = {tuple(r) for r in running(df, *args, source_rows=400).collect()}
    spread = {tuple(r) for r in running(df, *args).select(*running(df, *args, source_rows=400).columns).collect()}
    assert small == spread and len(small) == 400


def test_wilson_and_paired_test(spark):
    low, high = wilson(F.lit(543), F.lit(600))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == (pytest.approx(0.878895, abs=1e-6), pytest.approx(0.925952, abs=1e-6))
    cases = [(13, 42, 0.000113611), (39, 33, 0.556), (0, 0, 1.0), (8, 7, 1.0), (8, 11, 0.648), (22, 15, 0.324)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a int, b int")
    for r, (_, _, want) in zip(df.select(exact_sign_p("a", "b").alias("p")).collect(), cases):
        assert r.p == pytest.approx(want, rel=2e-3)
    big = spark.range(1).select(exact_sign_p(F.lit(100_000), F.lit(101_000)).alias("p")).first().p
    z = (1000 - 1) / math.sqrt(201_000)
    assert big == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def vectors(spark, n, key, seed):
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in g.integers(-2, 3, 4)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} long, vec array<double>"), dict(rows)


@pytest.mark.parametrize("values", [4_000_000, 40])
def test_nearest_one_pass_and_blocks(spark, values):
    q, qs = vectors(spark, 23, "query_id", 1)
    c, cs = vectors(spark, 150, "chunk_id", 2)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in dense.nearest(q, c, 5, cfg=Config(broadcast_values=values), dims=4).collect()}
    for qi, v in qs.items():
        def cos(w):
            n = np.linalg.norm(v) * np.linalg.norm(w)
            return round(float(np.dot(v, w) / n), 9) if n else 0.0

        want = sorted(((cos(w), ci) for ci, w in cs.items()), key=lambda t: (-t[0], t[1]))[:5]
        assert [got[qi, i + 1] for i in range(5)] == [(ci, pytest.approx(s)) for s, ci in want]


def test_similarities_in_one_copy_and_in_blocks(spark):
    rows, _ = vectors(spark, 37, "id", 3)
    anchors, _ = vectors(spark, 13, "anchor", 4)
    a, b = (dense.similarities(rows, anchors, cfg=Config(broadcast_values=v), dims=4) for v in (4_000_000, 20))
    assert {r.id: r.sims for r in a.collect()} == {r.id: r.sims for r in b.collect()} and a.count() == 37


def test_sparse_and_dense_vectors_agree(spark):
    docs = spark.createDataFrame([(1, 10, "alpha beta beta"), (2, 20, "gamma delta"), (3, 30, "!")], "doc_id long, chunk_id long, text string")
    sparse = vx.hashed_vectors(docs, ["doc_id", "chunk_id"], F.col("text"), 8)
    filled = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.get(F.filter("vec", lambda e: e["dim"] == i), F.lit(0))["v"], F.lit(0.0)))
    full = sparse.select("doc_id", "chunk_id", filled.alias("vec"))
    q = sparse.select(F.col("doc_id").alias("query_id"), "vec")
    qf = full.select(F.col("doc_id").alias("query_id"), "vec")
    a = dense.nearest(q, sparse, 3, dims=8).orderBy("query_id", "rank").collect()
    assert a == dense.nearest(qf, full, 3, dims=8).orderBy("query_id", "rank").collect() and len(a) == 9


def test_verbatim_gold_by_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["ab", "Cd", "xEf", "q", "zz", "the", "the", "the"]
    texts = ["".join(rnd.choice(vocab) + rnd.choice([" ", "-", ", ", "\n"]) for _ in range(40)) for _ in range(60)]
    texts += ["Весь мир это длинный текст.", "漢字 и это", ""]
    asked = [t[a : a + n] for t in texts[:20] for a, n in [(3, 12), (7, 30), (0, 9)]] + ["the the the", "zz, ab Cd", "Cd", "zz", "q", ", ", "мир это длинный", "это", "漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    qs = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = sorted((r.query_id, r.doc_id) for r in lexical.verbatim_gold(docs, qs).collect())
    assert got == sorted((i, d) for i, q in enumerate(asked) for d, t in enumerate(texts) if q in t)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (2, 2, "alpha alpha gamma"), (3, 3, "delta")], "doc_id long, chunk_id long, body string")
    q = spark.createDataFrame([(1, "alpha alpha gamma missing")], "query_id long, question string")
    got = {r.chunk_id: r.score for r in lexical.bm25(docs, q, F.col("body")).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert got == {1: pytest.approx(idf(2) * part(1, 2)), 2: pytest.approx(idf(2) * part(2, 3) + idf(1) * part(1, 3))}


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1, 0.5)], "query_id long, chunk_id long, rank int, score double")
    b = spark.createDataFrame([(1, 7, 3, 0.2), (1, 8, 1, 0.9)], "query_id long, chunk_id long, rank int, score double")
    got = {r.chunk_id: (r.rank, r.score, r.a) for r in hybrid.reciprocal_rank_fusion({"a": a, "b": b}, 10).collect()}
    assert got[7] == (1, pytest.approx(1 / 61 + 1 / 63), 0.5) and got[8] == (2, pytest.approx(1 / 61), None)


def scores(spark, rows):
    return spark.createDataFrame(rows, "ranker string, query_id long, chunk_id long, first_rank int, score double")


def test_min_max(spark):
    rows = [("a", 1, 1, 1, 2.0), ("a", 1, 2, 2, 4.0), ("a", 1, 3, 3, None), ("b", 1, 1, 1, 5.0), ("b", 1, 2, 2, 5.0), ("b", 1, 3, 3, 5.0)]
    got = {(r.ranker, r.chunk_id): (r.norm, r.pos) for r in fusion.ranked_scores(scores(spark, rows)).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == [(0.5, 2), (1.0, 1), (0.0, 3)]
    assert [got["b", i] for i in (1, 2, 3)] == [(0.0, 1), (0.0, 2), (0.0, 3)]


def test_grid_size_and_weight_invariance(spark):
    assert len(fusion.plan_grid(list("abcde"))) == 245
    g = random.Random(3)
    rows = [(r, q, c, c, g.choice([None, g.random()])) for r in "abc" for q in (1, 2) for c in range(1, 9)]
    lists_ = fusion.fuse_grid(scores(spark, rows), list("abc"))
    label = {i: name for i, name, _, _ in fusion.plan_grid(list("abc"))}
    by = {}
    for r in lists_.collect():
        by.setdefault(label[r.combo], []).append((r.query_id, r.rank, r.chunk_id))
    assert sorted(by["combsum(a×0.25 + b)"]) == sorted(by["combsum(a + b)"]) and len(by) == 63


def pairs(spark, n=25):
    rows = [(1, i, i, i, "alpha beta gamma", "alpha " * (i % 3) + "beta " * (i % 2) + "x" * 10) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, rank int, question string, passage string")


@pytest.mark.parametrize("name", ["single", "batched", "graded", "cascade"])
def test_rerank_is_a_permutation(spark, name):
    single = rerank.overlap_scorer(18)
    runs = {
        "single": lambda p: rerank.rerank(p, single), "graded": lambda p: rerank.rerank(p, rerank.graded_scorer()),
        "batched": lambda p: rerank.rerank(p, rerank.batched_scorer(single)),
        "cascade": lambda p: rerank.cascade(p.withColumn("first_rank", F.col("rank")), rerank.batched_scorer(single), single),
    }
    got = runs[name](pairs(spark)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 26)) and {r.chunk_id for r in got} == set(range(1, 26))
    if name == "cascade":
        assert all(r.score is None for r in got[10:])
    else:
        keys = [(r.score is None, -(r.score or 0), r.first_rank) for r in got]
        assert keys == sorted(keys)


def test_precomputed_without_rows_keeps_order(spark):
    table = spark.createDataFrame([(2, 1, 0.5)], "query_id long, chunk_id long, score double")
    got = rerank.rerank(pairs(spark, 5), rerank.precomputed_scorer(table)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2, 3, 4, 5] and all(r.score is None for r in got)


def test_abstention_scales(spark):
    rows = [("p", 1, 0.95, 1), ("p", 2, 0.3, 4), ("p", 3, None, 1), ("r", 1, 2.6, 1), ("n", 1, None, 1)]
    df = spark.createDataFrame(rows, "strategy string, query_id long, top_score double, first_rank int")
    got = {(r.strategy, r.threshold): (r.answered, r.precision) for r in metrics.abstention(df).collect()}
    assert got["p", 0.0] == (pytest.approx(2 / 3), 0.5) and got["p", 0.9] == (pytest.approx(1 / 3), 1.0)
    assert {t for s, t in got if s == "r"} == {0.0, 1.0, 1.5, 2.0, 2.5, 3.0} and not any(s == "n" for s, _ in got)


RANGE = "query_id long, doc_id long, start_line int, end_line int"


def test_ranges(spark):
    regions = spark.createDataFrame([(1, 1, 20, 30), (1, 1, 21, 30)], RANGE)
    ranges = spark.createDataFrame([(1, 1, 10, 20)], RANGE)
    assert intervals.region_recall(regions, ranges).first().region_recall == 0.5
    many = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 5, 7), (1, 1, 9, 12), (1, 2, 3, 3), (1, 1, 40, 41)], RANGE)
    assert intervals.covered_lines(many).first().lines == 15
    ws = spark.createDataFrame([(1, 1, 80 * i + 1, 80 * i + n, i + 1) for i, n in enumerate((80, 80, 10))], RANGE + ", rank int")
    budget = spark.createDataFrame([(1, 100)], "query_id long, lines long")
    assert [r["rank"] for r in intervals.budget_prefix(ws, budget).collect()] == [1]


def preds(spark, rows):
    return spark.createDataFrame(rows, "arm string, id long, gold int, pred int, conf double, pos long")


@pytest.mark.parametrize("rows", [None, 100])
def test_coverage_by_hand(spark, rows):
    right = [1, 1, 0, 1, 1]
    df = preds(spark, [("a", i, 1, r, 1 - i / 10, i) for i, r in enumerate(right)])
    ranked = classify.by_confidence(df, rows)
    assert classify.coverage_at(ranked, (0.8,)).first().coverage_80 == 1.0
    assert classify.coverage_at(ranked, (0.95,)).first().coverage_95 == 0.4


def test_gate_by_brute_force(spark):
    g = random.Random(9)
    rows = []
    for i in range(300):
        conf = round(g.random(), 5)
        rows.append(("a", i, 1, 1 if g.random() < 0.6 + conf * 0.45 else 0, conf, i))
    df = preds(spark, rows).withColumn("idx", F.col("pos"))
    got = classify.held_out_gate(df).first()
    dev, test = [r for r in rows if r[5] % 2 == 0], [r for r in rows if r[5] % 2 == 1]
    want = next(t for t in sorted({round(r[4], 4) for r in dev})
                if (k := [r[3] for r in dev if r[4] >= t]) and sum(k) / len(k) >= 0.95)
    kept = [r[3] for r in test if r[4] >= want]
    assert (got.threshold, got.coverage, got.accuracy) == (want, pytest.approx(len(kept) / len(test)), pytest.approx(sum(kept) / len(kept)))


def test_null_predictions_count_as_errors(spark):
    df = preds(spark, [("a", 1, 1, 1, 0.9, 1), ("a", 2, 1, None, None, 2), ("a", 3, 2, 1, 0.2, 3)])
    r = classify.accuracy(df).first()
    assert (r.n, r.right, r.errors) == (3, 1, 1)
    assert classify.macro_f1(df).first().macro_f1 == pytest.approx((2 * 1 / (2 + 2) + 0) / 2)
    assert classify.confident_enough(df).count() == 0


def test_seeded_draws(spark):
    def draws(seed, n):
        mul, out, a = (lambda x, y: (x * y) & 0xFFFFFFFF), [], seed
        for _ in range(n):
            a = (a + corpus.STEP) & 0xFFFFFFFF
            t = mul(a ^ (a >> 15), a | 1)
            t = ((t + mul(t ^ (t >> 7), t | 61)) & 0xFFFFFFFF) ^ t
            out.append((t ^ (t >> 14)) / 2**32)
        return out

    got = [r.d for r in spark.range(1, 51).select("id", corpus.seeded_draw(F.col("id"), DEFAULTS.seed).alias("d")).orderBy("id").collect()]
    assert got == draws(DEFAULTS.seed, 50)


@pytest.mark.parametrize("rows", [None, 10])
def test_question_ids(spark, rows):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A"), (3, "")], "pos int, node string")
    assert [r.id for r in corpus.question_ids(df, rows).orderBy("pos").collect()] == ["A", "B", "A.2", "Q"]


def test_last_success(spark):
    rows = [(1, "a", "x", None), (2, "b", "y", "1"), (3, "a", None, "2"), (4, "a", "z", "3"), (5, "b", "w", "4")]
    df = spark.createDataFrame(rows, "line int, id string, error string, v string")
    got = {r.id: (r.line, r.pos) for r in corpus.last_success(df, "id", "line", F.col("error").isNotNull()).collect()}
    assert got == {"a": (3, 1), "b": (2, 2)}
