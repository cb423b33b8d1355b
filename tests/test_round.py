"""Section relevance, nearest headings, batched judges, gates, cutting in proportion, and places in files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.functions import text as tx
from rankloom.operators import chunking, classify, fusion, metrics, rerank
from rankloom.plans.study import _document_of
from rankloom.sources import files, results


# --------------------------------------------------------------- section level


def test_relevance_of_document_and_section(spark):
    ranked = spark.createDataFrame([
        (1, 7, 1, "Other part", "A > Other part"), (1, 7, 2, "Overtime pay rules", "A > Overtime pay rules"), (1, 8, 3, "Overtime pay rules", ""),
        (1, 7, 4, "Deep", "Chapter on overtime pay rules > Deep"), (2, 9, 1, "x", ""),
    ], "query_id long, doc_id long, rank int, heading string, heading_path string")
    gold = spark.createDataFrame([(1, 7, ["Overtime pay rules"]), (2, 9, [])], "query_id long, doc_id long, sections array<string>")
    got = {(r.query_id, r["rank"]): (r.rel_doc, r.rel_section) for r in metrics.flag_sections(ranked, gold).collect()}
    assert got == {(1, 1): (True, False), (1, 2): (True, True), (1, 3): (False, False), (1, 4): (True, True), (2, 1): (True, False)}
    levels = metrics.by_level(metrics.flag_sections(ranked, gold)).groupBy("level").agg(F.count_if("rel").alias("n")).collect()
    assert {r.level: r.n for r in levels} == {"doc": 4, "section": 2}


def test_nearest_headings_in_document_order(spark):
    chunks = spark.createDataFrame([
        (1, 3, "Third overtime note", ""), (1, 0, "Overtime in general", ""), (1, 1, "Pay", ""), (1, 2, "Overtime at night", ""), (1, 4, "More OVERTIME", ""),
        (2, 0, "Holiday pay rules", ""), (3, 0, "pay", ""),
    ], "doc_id long, ordinal int, heading string, heading_path string")
    gold = spark.createDataFrame([(1, 1, ["12 § Overtime compensation matters"]), (2, 2, ["Holiday pay rules"]), (3, 3, ["Pays nothing special"]), (4, 4, ["Absent document"]),
                                  (5, 3, [])], "query_id long, doc_id long, sections array<string>")
    got = {r.query_id: r.nearest for r in metrics.nearest_headings(gold, chunks).collect()}
    assert got == {1: ["Overtime in general", "Overtime at night", "Third overtime note"], 3: [], 4: [], 5: []}


def test_means_are_taken_over_evaluable_questions(spark):
    base = spark.createDataFrame([("s", 1), ("s", 2), ("t", 2)], "strategy string, query_id int")
    ranked = spark.createDataFrame([("s", 1, 1, True), ("s", 3, 1, True)], "strategy string, query_id int, rank int, rel boolean")
    filled = metrics.fill_empty(base, metrics.query_metrics(ranked, ["strategy", "query_id"]))
    assert {(r.strategy, r.query_id): r.hit_at_1 for r in filled.collect()} == {("s", 1): 1, ("s", 2): 0, ("t", 2): 0}


# --------------------------------------------------------------------- judges


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(q, 100 * q + i, i, 0.5 if i == 4 else None if i == 7 else (i * 37 % 11) / 11, 10 * i, 5) for q in (1, 2) for i in range(1, 24)]
    return spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, overlap double, passage_chars int, question_chars int")


def test_batched_scores_equal_single_ones(pairs):
    single, batched = rerank.overlap_scorer(), rerank.batched_scorer(rerank.overlap_scorer(), 10)
    columns = ["query_id", "chunk_id", "rank", "score"]
    assert sorted(rerank.rerank(pairs, single).select(columns).collect(), key=repr) == sorted(rerank.rerank(pairs, batched).select(columns).collect(), key=repr)
    made = rerank.requests(rerank.rerank(pairs, batched), 10, "first_rank").where("query_id = 1").orderBy("batch").collect()
    assert [(r.batch, r.candidates, r.unanswered, r.input_units) for r in made] == [(0, 10, 1, 555), (1, 10, 0, 1555), (2, 3, 0, 665)]


def test_head_is_judged_and_tail_keeps_its_place(pairs):
    first = pairs.withColumnRenamed("rank", "first_rank")
    got = sorted((r["rank"], r.first_rank, r.score) for r in rerank.judge_head(first, rerank.overlap_scorer(), 10, "first_rank").where("query_id = 1").collect())
    assert [(rank, before) for rank, before, _ in got[10:]] == [(i, i) for i in range(11, 24)] and all(s is None for *_, s in got[10:])
    assert got[9][1] == 7 and got[9][2] is None  # unanswered ones end the head
    assert [s for *_, s in got[:9]] == sorted((s for *_, s in got[:9]), reverse=True)


def test_failures_of_both_passes_count(pairs):
    used = {m: rerank.usage(pairs.withColumn("score", F.col("overlap")), m).where("query_id = 1").first() for m in ("single", "batched", "cascade")}
    assert (used["single"].failed, used["batched"].failed, used["cascade"].failed) == (1, 1, 2)
    assert (used["single"].requests, used["batched"].requests, used["cascade"].requests) == (23, 2, 12)


def test_an_arm_without_confidence_is_not_gated(spark):
    rows = spark.createDataFrame([("a", i, None if i == 0 else 0.5) for i in range(40)] + [("b", i, None if i % 2 else 0.5) for i in range(40)], "arm string, id int, conf double")
    assert {r.arm for r in classify.gated(rows).select("arm").distinct().collect()} == {"a"}


def test_unfinished_arms_are_left_out(spark):
    test = spark.createDataFrame([(i,) for i in range(5)], "id int")
    rows = spark.createDataFrame([("a", i, "x", "x") for i in range(5)] + [("b", i, "x", "x") for i in (0, 0, 1, 2, 9)], "arm string, id int, gold string, pred string")
    assert {(r.arm, r.n) for r in classify.accuracy(classify.complete_arms(rows, test)).collect()} == {("a", 5)}


def test_answers_models_and_costs(spark):
    rows = spark.createDataFrame([("a", None, "Label: Yes!", "m2", 0.1), ("a", "no", "yes", "m1", 0.3), ("b", None, None, None, 0.5), ("b", None, "perhaps", "", None)],
                                 "arm string, pred string, raw string, model string, usd double")
    labels = F.array(F.lit("yes"), F.lit("no"))
    assert sorted((r.arm, r.pred) for r in classify.reparsed(rows, labels).where("pred is not null").collect()) == [("a", "no"), ("a", "yes")]
    assert {r.arm: r.models for r in classify.models(rows).collect()} == {"a": ["m1", "m2"]}
    assert {r.arm: r.usd_per_1000 for r in classify.cost_per_thousand(rows, "arm", F.col("usd"), {"a": 1.5}).collect()} == {"a": 201.5, "b": 500.0}


def test_samples_per_label(spark):
    rows = spark.range(200).selectExpr("id", "if(id % 3 = 0, 'hot', if(id < 4, 'rare', 'other')) as label")
    got = classify.sample_per_label(rows, 6).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"hot": 6, "rare": 2, "other": 6}
    assert sorted(classify.sample_per_label(rows.repartition(7), 6).collect()) == sorted(classify.sample_per_label(rows, 6).collect())


# --------------------------------------------------------------------- fusion


def test_grid_equals_fusing_each_combination(spark):
    rows = [(q, c, c, ranker, None if (q + c + k) % 7 == 0 else ((q * 31 + c * 17 + k * 5) % 23) / 3.0)
            for q in (1, 2) for c in range(1, 13) for k, ranker in enumerate(("x", "y", "z"))]
    scores = spark.createDataFrame(rows, "query_id int, chunk_id int, first_rank int, ranker string, score double")
    grid = {}
    for r in fusion.fuse_grid(scores, ["x", "y", "z"]).collect():
        grid.setdefault(r.combo, {})[r.query_id, r["rank"]] = r.chunk_id
    for i, label, method, weights in fusion.plan_grid(["x", "y", "z"]):
        if len(weights) > 1 and set(weights.values()) == {1.0}:
            one = fusion.fuse(scores.where(F.col("ranker").isin(*weights)), method)
            assert grid[i] == {(r.query_id, r["rank"]): r.chunk_id for r in one.collect()}, label


def test_first_combinations_by_dev(spark):
    grid = spark.createDataFrame([(i, f"c{i}", (i % 4) / 4) for i in range(20)], "combo int, label string, dev_r1 double")
    got = fusion.best_by_dev(grid, 6).orderBy("place").collect()
    assert [(r.place, r.label) for r in got] == [(1, "c3"), (2, "c7"), (3, "c11"), (4, "c15"), (5, "c19"), (6, "c2")]


# -------------------------------------------------------------------- cutting


def page(n):
    return "\n".join(f"{'#' * (1 + i % 4)} Heading {i}\n" + ("text " * (i % 40)) for i in range(n))


def test_headings_are_cut_in_proportion(spark):
    """Sixteen times the headings of one page take well under sixteen times sixteen times the time."""
    seconds = {}
    for n in (200, 200, 3200):
        docs = spark.createDataFrame([(1, page(n))], "doc_id long, text string")
        start = time.perf_counter()
        assert chunking.markdown_chunks(docs, Config()).count() > n / 10
        seconds[n] = time.perf_counter() - start
    assert seconds[3200] < 40 * max(seconds[200], 0.25)


def test_paths_of_open_headings(spark):
    docs = spark.createDataFrame([(1, page(300))], "doc_id long, text string")
    got = docs.select(F.explode(chunking.markdown_sections(F.col("text"))).alias("s")).select("s.*").collect()
    chain, want = [], []
    for i in range(300):
        chain = [c for c in chain if c[0] < 1 + i % 4] + [(1 + i % 4, f"Heading {i}")]
        want.append((f"Heading {i}", " > ".join(h for _, h in chain), [("text " * (i % 40))] if i < 299 else ["text " * (299 % 40)]))
    assert [(r.heading, r.path, r.body) for r in got] == want


def test_fold_over_many_groups(spark):
    items = spark.range(1).select(chunking.fold(
        F.sequence(F.lit(1), F.lit(500)), F.lit(0), "int",
        lambda s, x: F.struct((s + x).alias("state"), F.when(x % 3 == 0, F.array(s)).otherwise(F.array().cast("array<int>")).alias("out")),
        lambda s: F.array(s)).alias("x")).first().x
    assert items == [*(sum(range(x)) for x in range(3, 501, 3)), sum(range(501))]


def test_file_lists_of_any_length(spark):
    cases = {"a.md, b, c.MD,, d": ["a.md", "b, c.MD", "d"], "": [], " , ": [], "x": ["x"], "one.md,two.md": ["one.md", "two.md"], "a.mdx, b.md": ["a.mdx, b.md"]}
    long = ",".join(f"file {i}.md" for i in range(20_000))
    rows = spark.createDataFrame([(t,) for t in [*cases, long]], "t string").select("t", tx.split_file_list(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows if r.t in cases} == cases
    assert next(len(r.x) for r in rows if r.t == long) == 20_000


def test_ids_of_negative_documents_come_back(spark):
    docs = spark.createDataFrame([(-3, "t", "alpha beta\n\n" + "gamma " * 400), (5, "t", "alpha delta"), (2**31 - 1, "t", "beta")], "doc_id long, title string, text string")
    chunks = chunking.document_chunks(docs)
    wrong = chunks.where(_document_of("chunk_id") != F.col("doc_id"))
    assert wrong.count() == 0 and chunks.where("doc_id = -3").count() > 1


# --------------------------------------------------------------------- places


def test_ids_follow_file_order_over_several_files(spark, tmp_path):
    """The middle file is the largest, so a task takes it first; the ids still follow the names."""
    at = 0
    for name, n in (("a", 3), ("b", 400), ("c", 5)):
        rows = [(f"t{at + i}" + "x" * (200 if name == "b" else 0), "l") for i in range(n)]
        spark.createDataFrame(rows, "text string, label_text string").coalesce(1).write.parquet(str(tmp_path / f"raw-{name}"))
        part = next((tmp_path / f"raw-{name}").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"{name}.parquet").write_bytes(part.read_bytes())
        at += n
    got = files.labelled_messages(spark, str(tmp_path / "all"), "m").collect()
    assert {r.id: r.text.rstrip("x") for r in got} == {f"m{i}": f"t{i}" for i in range(at)}


def test_newest_attempt_wins_whatever_the_file_names(spark, tmp_path):
    def line(attempt, pred, error=None):
        return json.dumps({"id": "q", "pred": pred, "error": error, "attempt": attempt}) + "\n"

    log = tmp_path / "log"
    log.mkdir()
    (log / "part-b.json").write_text(line(1, "first"))
    (log / "part-a.json").write_text(line(2, "second") + line(2, "failed later", "timeout"))
    one = results.read_predictions(spark, str(log)).collect()
    assert [(r.id, r.pred) for r in one] == [("q", "second")] and results.last_attempt(spark, str(log)) == 2


def test_appending_counts_attempts_and_skips_what_is_done(spark, tmp_path):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = str(tmp_path / "log")
    fails = lambda bad: lambda d: d.select("id", F.lit("x").alias("pred"), F.when(F.col("id").isin(bad), "down").alias("error"))
    assert results.append_predictions(todo, log, fails(["b", "c"])) == 3
    assert results.append_predictions(todo, log, fails(["c"])) == 2
    assert results.append_predictions(todo, log, fails([])) == 1
    assert results.append_predictions(todo, log, fails([])) == 0
    assert results.last_attempt(spark, log) == 3
    assert {r.id: r.error for r in results.read_predictions(spark, log).collect()} == {"a": None, "b": None, "c": None}


def test_carriage_returns_inside_quotes_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('name;text\n a ;"x\r\ny; ""z"""\nb;plain\r\n;\nc\n'.encode())
    got = sorted((r.name, r.text) for r in files.delimited(spark, str(tmp_path / "t.csv")).collect())
    assert got == [("a", 'x\r\ny; "z"'), ("b", "plain"), ("c", "")]


def test_rows_that_end_in_both_characters(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('name;text\r\n a ;"x\r\ny"\r\nc\r\n'.encode())
    assert sorted((r.name, r.text) for r in files.delimited(spark, str(tmp_path / "t.csv")).collect()) == [("a", "x\ny"), ("c", "")]
