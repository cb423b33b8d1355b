"""Metrics over all questions, batch-relative scores, and work in bounded pieces."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.config import Config
from rankloom.functions import vectors
from rankloom.operators import dense, learned, lexical, metrics, postings, rerank
from rankloom.plans.study import Study


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """Question 1 stands in document 10; question 2 stands in none, question 3 is empty."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(10, "alpha beta gamma delta epsilon zeta", "en", "s", 35), (11, "beta gamma other words follow here", "en", "s", 34)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    asked = [(1, "beta gamma delta epsilon"), (2, "gamma beta alpha other"), (3, "")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return Study(spark, path)


@pytest.mark.parametrize("made,strategies", [("stage_metrics", ["fts", "vector", "hybrid"]), ("strategy_metrics", Study.STRATEGIES)])
def test_questions_without_gold_are_measured(study, made, strategies):
    rows = {(r.strategy, r.query_id): (r.first_rank, r.rr) for r in getattr(study, made)().collect()}
    assert set(rows) == {(s, q) for s in strategies for q in (1, 2, 3)}
    assert rows[strategies[0], 1][0] is not None and all(rows[s, q] == (None, 0.0) for s in strategies for q in (2, 3))


def test_movement_and_outcomes_count_questions_without_gold(study):
    """Failed while the metrics were taken over questions with gold only."""
    pair = metrics.paired_ranks(study.strategy_metrics(), "hybrid")
    moved = {r.strategy: r.moved_up + r.moved_down + r.unchanged for r in metrics.movement(pair).collect()}
    assert moved == {s: 3 for s in Study.STRATEGIES[1:]}
    missed = sorted((r.strategy, r.query_id) for r in metrics.outcome(pair).where("outcome = 'missed'").collect())
    assert missed == sorted((s, q) for s in Study.STRATEGIES[1:] for q in (2, 3))


def test_relative_scores_are_shares_of_the_best_in_the_request(spark):
    rows = [(1, i, i, x, 5, 5) for i, x in enumerate([0.2, 0.4, None, 0.9, 0.3, 0.0, 0.0], 1)]
    pairs = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, overlap double, passage_chars int, question_chars int")
    judge = rerank.batched_scorer(rerank.overlap_scorer(), 3, relative=True)
    got = sorted((r.first_rank, r.score, r["rank"]) for r in rerank.rerank(pairs, judge).collect())
    assert got == [(1, 0.5, 3), (2, 1.0, 1), (3, None, 6), (4, 1.0, 2), (5, 0.333333, 4), (6, 0.0, 5), (7, None, 7)]


def test_batched_strategy_judges_relative_to_the_request(study):
    top = study.reranked("hybrid+batched").where("query_id <> 3").groupBy("query_id").agg(F.max("score").alias("top")).collect()
    assert {r.query_id: r.top for r in top} == {1: 1.0, 2: 1.0}


@pytest.mark.parametrize("cells,rows,waiting", [(40, 3, 5), (500_000, 2_048, 65_536), (7, 1, 10_000)])
def test_best_rows_whatever_the_pieces(monkeypatch, cells, rows, waiting):
    """Ties, zero vectors and repeated ids included."""
    for name, value in (("SIMILARITY_VALUES", cells), ("QUERY_ROWS", rows), ("WAITING", waiting)):
        monkeypatch.setattr(dense, name, value)
    rnd = np.random.default_rng(5)
    q, c = rnd.integers(-1, 2, (10, 3)).astype(float), rnd.integers(-1, 2, (200, 3)).astype(float)
    q[4] = 0
    ids = rnd.permutation(150).repeat(2)[:200]
    for k in (1, 6, 250):
        best = dense.Best(q, k, True)
        for at in range(0, 200, 60):
            best.add(ids[at:at + 60], c[at:at + 60])
        got = [x for part in best.pairs(np.arange(10) * 7) for x in zip(*(part[n].tolist() for n in ("query_id", "chunk_id", "score")), strict=True)]
        sims = np.round(dense._similarity(q, c, True), dense.SCORE_DIGITS)
        want = [(i * 7, int(ids[j]), float(sims[i, j])) for i in range(10) for j in np.lexsort((ids, -sims[i]))[:k]]
        assert sorted(got) == sorted(want)


def test_work_arrays_do_not_grow_with_the_questions():
    """Before: 1,900 questions of 20 terms in one block took over 70 MB at once, and 2,048 x 3,000 similarities over 120 MB."""
    rnd = np.random.default_rng(6)
    rows = pa.table({"query_id": np.repeat(np.arange(1_900), 20), "term": [f"w{i}" for i in rnd.integers(0, 300, 38_000)], "weight": rnd.random(38_000)})
    search = postings._Best(postings._asked(rows), lambda mark, length: mark / (mark + length), 5)
    n = len(search.asked.terms)
    flat = np.tile(np.arange(128), n), np.ones(128 * n, int), np.full(128 * n, 9)
    near = dense.Best(rnd.normal(size=(2_048, 8)), 5, True)
    many = np.arange(3_000), rnd.normal(size=(3_000, 8))
    for run, most in ((lambda: search.block(np.arange(n), np.ones(n, int), np.full(n, 9), *flat, np.full(n, 128)), 45 << 20), (lambda: near.add(*many), 60 << 20)):
        tracemalloc.start()
        run()
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert used < most, used


def test_tokens_are_counted_where_messages_lie(spark):
    """Before: every token of every message was shuffled, and each vector went through Python."""
    rows = [(1, "ab ab cd", "x"), (2, "ab", "y"), (2, "ab ef", "y"), (None, "gh", "x"), (3, "", "x"), (4, None, "y")]
    messages = spark.createDataFrame(rows, "id long, text string, label string")
    counts = learned._term_counts(messages)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + \
        counts._jdf.queryExecution().executedPlan().toString().count("REPARTITION") <= 2  # both name the one exchange
    held = {(r.id, r.term): r.tf for r in counts.where("block = 'w'").collect()}
    assert held == {(1, "ab"): 2, (1, "cd"): 1, (1, "ab ab"): 1, (1, "ab cd"): 1, (2, "ab"): 2, (2, "ef"): 1, (2, "ab ef"): 1, (None, "gh"): 1}
    (features,) = learned.tfidf_features(messages)
    assert "Python" not in features._jdf.queryExecution().executedPlan().toString()
    made = sorted(((r.id, r.features) for r in features.collect()), key=repr)
    assert [i for i, _ in made] == [1, 2, 2, 3, 4, None]
    for i, vector in made:
        assert vector.size == 90_000 and list(vector.indices) == sorted(set(vector.indices.tolist()))
        parts = [sum(x * x for k, x in zip(vector.indices, vector.values) if (k < 30_000) == word) for word in (True, False)]
        assert parts[0] == pytest.approx(0 if i in (3, 4, None) and not len(vector.indices) else 1)


def test_slices_of_messages_do_not_grow_with_the_table(spark, monkeypatch):
    """Before: as many slices as shuffle partitions, however much text there was. The counts are the same."""
    messages = spark.createDataFrame([(i % 37, f"word{i % 5} other{i % 3} text", "a") for i in range(200)] + [(None, None, "a")], "id long, text string, label string")
    counted = lambda: learned._term_counts(messages)
    want, width = sorted(counted().collect(), key=repr), session.shuffle_width(spark)
    slices = lambda: counted().select("id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count()
    assert 1 < slices() <= width
    monkeypatch.setattr(learned, "SLICE_CHARS", 100)
    assert slices() > 2 * width and sorted(counted().collect(), key=repr) == want


def test_hashing_does_not_grow_with_the_batch(spark):
    """Before: the 10,000 windows of one batch were hashed at once, which took over 100 MB; the vectors are the same."""
    rnd = np.random.default_rng(7)
    offsets = np.concatenate([[0], np.cumsum(rnd.integers(0, 400, 10_000))])
    known = pa.array([f"w{i}" for i in range(5_000)])
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), known.take(pa.array(rnd.integers(0, 5_000, offsets[-1]))))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), tokens], names=["id", "tokens"])
    tracemalloc.start()
    made = list(vectors._hashing(["id"], 64)(iter([batch])))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 40 << 20, used
    table = pa.Table.from_batches(made)
    assert table.column("id").to_pylist() == list(range(10_000))
    for i in (0, 511, 512, 9_999):
        want = [0] * 64
        for word in tokens[i].as_py():
            dim, sign = vectors._slots([word], 64)
            want[dim[0]] += sign[0]
        got = {x["dim"]: x["v"] for x in table.column("vec")[i].as_py()}
        assert [got.get(d, 0) for d in range(64)] == want


def test_pages_that_ask_the_same_are_searched_once(spark, tmp_path, monkeypatch):
    """Before: the search ran for each of the pages. Page 40 has no heading, page 50 stands in the table twice."""
    names = {10: "Alpha beta", 20: "Gamma", 21: "Other words", 30: "Alpha beta", 50: "Alpha beta"}
    html = {i: f"<title>t{i % 3}</title><h1>{h}</h1><p>{h} and text of page number {i}</p>" for i, h in names.items()} | {40: "<p>alpha</p>"}
    rows = [(i, f"http://a/{i}", html[i]) for i in [*html, 50]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages, seen = Study(spark, str(tmp_path)), []
    real = lexical.bm25_topk
    monkeypatch.setattr(lexical, "bm25_topk", lambda units, asked, *rest: seen.append(sorted((r.query_id, r.question) for r in asked.collect())) or real(units, asked, *rest))
    plain = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    got = plain(pages.page_list().distinct())
    assert seen[0] == [(10, "Alpha beta"), (20, "Gamma"), (40, ""), (50, "Alpha beta"), (50, "Alpha beta")]
    text = F.concat_ws("\n", "heading_path", "body")
    assert got == plain(real(pages.page_chunks(), pages.page_questions, text, 30, pages.cfg).distinct())
    assert {q for q, *_ in got} == {10, 20, 30, 50}


def test_page_metrics_ask_every_page(spark, tmp_path):
    """Before: only pages whose id is divisible by 10 were asked. Page 4 has no heading, page 7 stands twice."""
    html = lambda h: f"<h1>{h}</h1><p>{h} and the text of a page</p>"
    names = [(10, "Alpha beta"), (3, "Gamma delta"), (7, "Other words"), (7, "Other words")]
    rows = [(i, f"http://a/{i}", html(h)) for i, h in names] + [(4, "http://a/4", "<p>alpha</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = Study(spark, str(tmp_path), Config(chunk_min_chars=1))
    scored = {(r.strategy, r.query_id): r.hit_at_1 for r in pages.page_metrics().collect()}
    assert scored == {("doc", i): int(i != 4) for i in (3, 4, 7, 10)} | {("section", i): 1 for i in (3, 7, 10)}
    means = {r.strategy: (r.n, r.hit_at_1) for r in metrics.aggregate_metrics(pages.page_metrics(), ["strategy"]).collect()}
    assert means == {"doc": (4, 0.75), "section": (3, 1.0)}
    assert {r.query_id for r in pages.page_list().collect()} == {10}


@pytest.mark.parametrize("values", [4_000_000, 128])
def test_vectors_are_made_and_compared_by_one_worker(spark, values):
    """Before: two Python operators one behind the other, so each core held two workers. 128 values leave the single copy."""
    known = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = spark.createDataFrame([(i, " ".join(known[(i * j) % 5] for j in range(i % 7))) for i in range(40)], "chunk_id int, text string")
    asked = spark.createDataFrame([(i, f"{known[i]} {known[i - 1]} {i}{i}") for i in range(4)] + [(9, "")], "query_id int, text string")
    queries = vectors.hashed_vectors(asked, ["query_id"], F.col("text"))
    rows, made = vectors.hashed_batches(docs, ["chunk_id"], F.col("text"))
    cfg = Config(broadcast_values=values)
    got = dense.nearest(queries, rows, 6, cfg=cfg, made=made)
    if values > 128:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = dense.nearest(queries, vectors.hashed_vectors(docs, ["chunk_id"], F.col("text")), 6)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and want.count() == 30


def test_workers_get_bounded_batches(spark):
    """Before: up to the session's 10,000 rows at once, so what a worker held grew until such batches were full."""
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    given = lambda: [r.n for r in session.stored(spark.range(0, 9_000, 1, 1).mapInArrow(sizes, "n long")).collect()]
    before = spark.conf.get(session.ARROW_ROWS)
    assert sum(given()) == 9_000 and max(given()) <= session.BATCH_ROWS
    assert spark.conf.get(session.ARROW_ROWS) == before
    try:
        spark.conf.set(session.ARROW_ROWS, "100")
        assert max(given()) == 100 and spark.conf.get(session.ARROW_ROWS) == "100"
    finally:
        spark.conf.set(session.ARROW_ROWS, before)


def test_shortlists_search_on_bounded_batches(spark, tmp_path, monkeypatch):
    """Before: searches and vectors ran on batches of the session's size."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(session, "BATCH_ROWS", 8)

    def noted(run):
        return lambda batches: run(b for b in batches if b.num_rows <= 8 or seen.add(1) is None)

    searching, hashing = postings._searching, vectors._hashing
    monkeypatch.setattr(postings, "_searching", lambda *a: noted(searching(*a)))
    monkeypatch.setattr(vectors, "_hashing", lambda *a: noted(hashing(*a)))
    texts = [(i, f"alpha beta w{i % 3} x{i % 5} y{i % 7}", "en", "s", 30) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha w1 x2 y3"), (2, "beta y1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    study = Study(spark, str(tmp_path), Config(candidate_k=5, chunk_min_chars=1))
    made = [study.ranker_scores(), study.bm25_list(5), *(study.shortlists(s) for s in ("fts", "vector", "hybrid"))]
    assert [x.count() for x in made] == [30, 10, 10, 10, 10]
    assert seen.value == 0


def test_ties_at_the_limit_do_not_grow_with_the_units():
    """Before: every unit that tied with a question's k-th best stayed with the task and left it."""
    rows = pa.table({"query_id": [1, 1, 2], "term": ["a", "b", "b"], "weight": [1.0, 1.0, 1.0]})
    search, ids, scores = postings._Best(postings._asked(rows), lambda mark, length: mark * 1, 4, waiting=50), [], []
    for block in range(30):
        own = np.arange(10)[::-1] * 30 + block
        marks = (own % 3 == 0) + 1
        one = np.array([list(search.asked.terms.to_pylist()).index("b")])
        search.block(one, np.array([2]), np.array([9]), own, marks, np.full(10, 9), np.array([10]))
        ids, scores = [*ids, *own], [*scores, *marks]
    search.cut()
    question, unit, score = search.kept[0]
    order = np.lexsort((ids, -np.array(scores)))[:4]
    for q in (0, 1):
        mine = np.flatnonzero(question == q)
        assert len(mine) <= 8
        first = mine[np.lexsort((unit[mine], -score[mine]))[:4]]
        assert unit[first].tolist() == np.array(ids)[order].tolist() and score[first].tolist() == np.array(scores)[order].tolist()


def test_what_waits_does_not_grow_with_the_pieces(monkeypatch):
    """Before: each opened block and each batch left its arrays with the task, even with no row in them."""
    rows = pa.table({"query_id": [1, 1], "term": ["a", "b"], "weight": [1.0, 1.0]})
    search = postings._Best(postings._asked(rows), lambda mark, length: mark * 1, 2, waiting=100)
    place = np.argsort(search.asked.terms.to_pylist())
    both = place, np.array([5, 5]), np.array([9, 9])
    search.block(*both, np.array([1, 2, 1, 2]), np.array([5, 4, 5, 4]), np.full(4, 9), np.array([2, 2]))
    search.cut()
    for i in range(1_000):  # the bound is 10, the units give 5; every tenth block holds one that ties with the second
        search.block(*both, np.array([10 + i, 3_000 + i]), np.array([5, 5]), np.full(2, 9), np.array([1, 1]))
        if i % 10 == 0:
            search.block(*both, np.array([5_000 + i, 5_000 + i]), np.array([4, 4]), np.full(2, 9), np.array([1, 1]))
        assert len(search.kept) <= 6
    search.cut()
    assert [x.tolist() for x in search.kept[0]] == [[0] * 3, [1, 2, 5_000], [10.0, 8.0, 8.0]]
    monkeypatch.setattr(dense, "WAITING", 100)
    near = dense.Best(np.array([[1.0, 0.0]]), 2, True)
    for i in range(1_000):
        near.add(np.array([i]), np.array([[1.0, min(i, 5)]]))
        assert len(near.kept[0]) <= 6
    assert next(near.pairs(np.array([7])))["chunk_id"].tolist() == [0, 1]
