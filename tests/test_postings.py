"""The stored index: exact best units whatever the blocks, parts and ties."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.stemming import stem, stem_table
from rankloom.functions.text import code_tokens, words
from rankloom.operators import lexical, postings


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    vocab = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(300)]
    rows = [(i, i * 7, "" if i % 50 == 0 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60)))) for i in range(700)]
    return spark.createDataFrame(rows, "doc_id long, chunk_id long, body string").repartition(5), rows


@pytest.fixture(scope="module")
def asked(spark):
    rnd = random.Random(4)
    rows = [(q, " ".join(f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(12))) for q in range(25)] + [(90, "nothing known"), (91, ""), (92, "w1 w1 w1")]
    return spark.createDataFrame(rows, "query_id long, question string")


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("units,part_rows,waiting", [(1, 500_000, 1_000_000), (16, 500_000, 50), (128, 40, 10), (10_000, 500_000, 1_000_000)])
def test_best_equals_scoring_everything(spark, texts, asked, monkeypatch, units, part_rows, waiting):
    monkeypatch.setattr(postings, "BLOCK_UNITS", units)
    monkeypatch.setattr(postings, "PART_ROWS", part_rows)
    monkeypatch.setattr(postings, "WAITING", waiting)
    every = lexical.best_k(lexical.bm25(texts[0], asked, F.col("body")), 7)
    assert ranked(lexical.bm25_topk(texts[0], asked, F.col("body"), 7)) == ranked(every)
    match = lexical.best_k(lexical.weighted_match(texts[0], asked, F.lit(""), F.col("body")), 5)
    assert ranked(lexical.weighted_topk(texts[0], asked, F.lit(""), F.col("body"), 5)) == ranked(match)


def test_blocks_below_the_limit_are_not_unfolded(spark, texts, asked):
    """In one task over small blocks the limits rise, and most (question, block) cells stay closed."""
    index = postings.build(texts[0], code_tokens(F.col("body")), block_units=4)
    terms, weights, part = lexical._bm25_terms(index, asked, lexical.DEFAULTS)
    unfolded = []
    rows = weights.select("query_id", "term", F.col("weight").cast("double")).toArrow()
    for k in (1, 700):
        best = postings._Best(postings._asked(rows), part, k)
        held = index.postings.join(weights.select("term").distinct(), "term").orderBy("block").toArrow()
        cells = 0
        for block in held.column("block").unique().to_pylist():
            mine = held.filter(postings.pc.equal(held.column("block"), block)).combine_chunks()
            before = sum(len(x[0]) for x in best.kept)
            flat = [mine.column(c).combine_chunks().flatten().to_numpy() for c in ("chunk_ids", "marks", "lens")]
            best.block(postings.pc.index_in(mine.column("term"), best.asked.terms).to_numpy(), *(mine.column(c).to_numpy() for c in ("top", "shortest")), *flat, mine.column("n").to_numpy())
            cells += sum(len(x[0]) for x in best.kept) - before
            best.cut()
        unfolded.append(cells)
    assert unfolded[0] < unfolded[1] / 2


def test_headers_and_totals(texts):
    index = lexical.bm25_index(texts[0], F.col("body"))
    counted = [collections.Counter(t.split()) for _, _, t in texts[1]]
    assert index.totals() == (700, sum(map(lambda c: sum(c.values()), counted)) / 700)
    df = collections.Counter(t for c in counted for t in c)
    terms = texts[0].sparkSession.createDataFrame([(0, t) for t in (*list(df)[:20], "absent")], "query_id int, term string")
    assert {r.term: r.df for r in postings.frequencies(index, terms).collect()} == {t: df[t] for t in list(df)[:20]}
    wrong = index.postings.where((F.col("top") != F.array_max("marks")) | (F.col("shortest") != F.array_min("lens")) | (F.col("n") != F.size("chunk_ids")))
    assert wrong.count() == 0


def test_no_units_and_no_questions(spark, texts, asked):
    assert lexical.bm25_topk(texts[0].where("false"), asked, F.col("body"), 3).count() == 0
    assert lexical.bm25_topk(texts[0], asked.where("false"), F.col("body"), 3).count() == 0
    assert lexical.bm25_topk(texts[0].withColumn("body", F.lit(None).cast("string")), asked, F.col("body"), 3).count() == 0


def test_equal_scores_go_by_id(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "299 - id as chunk_id", "'same words' as body").repartition(4)
    got = lexical.bm25_topk(docs, spark.createDataFrame([(1, "words")], "query_id long, question string"), F.col("body"), 9).collect()
    assert sorted(r.chunk_id for r in got) == list(range(9))


def test_asking_words_of_a_stem_equals_stemming_every_word(spark):
    texts = ["talossa on talo ja talot", "autossa autoja", "talon auto", "kissa ja koira", ""]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, chunk_id long, body string")
    got = lexical.stemmed_topk(docs, spark.createDataFrame([(1, "talossa autoa")], "query_id long, question string"), F.lit(""), F.col("body"), 9)
    stop = {"on", "ja"}
    want = {stem("talossa"), stem("autoa")}
    counted = {i: sum(stem(w) in want for w in t.split() if w not in stop) for i, t in enumerate(texts)}
    assert {r.chunk_id: r.score for r in got.collect()} == {i: n * 4 / 10 for i, n in counted.items() if n}
    table = {r.term: r.stem for r in stem_table(docs.select(F.explode(words(F.col("body"))).alias("term")).distinct()).collect()}
    assert "ja" not in table and table["talossa"] == stem("talossa")
