import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankloom import api
from rankloom.operators import chunking, rerank
from rankloom.sources import files, results
from rankloom.streaming.append_log import answer_new_work


def test_markdown_tree(spark, tmp_path):
    for path, text in {"laws/L1_b.md": "B", "laws/README.md": "no", "guides/L1_b.md": "copy", "guides/AB12_a.md": "A", "guides/x.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = files.in_reading_order(files.markdown_tree(spark, str(tmp_path))).collect()
    assert [(r.file, r.folder, r.title, r.text, r.bytes) for r in got] == [("AB12_a.md", "guides", "a", "A", 1), ("L1_b.md", "guides", "b", "copy", 4)]


def test_source_tree(spark, tmp_path):
    for path in ("a/x.py", "a/README.rst", "b/y.txt", "b/z.go"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(b"ok\xff")
    got = sorted((r.file, r.text) for r in files.source_tree(spark, str(tmp_path)).collect())
    assert got == [("a/README.rst", "ok�"), ("a/x.py", "ok�"), ("b/z.go", "ok�")]


def test_ground_truth(spark, tmp_path):
    p = tmp_path / "gt.csv"
    p.write_text('﻿node; question ;files;source_sections\nA;"multi\nline ""q""";a, b.md,c.md;12 § X, 13 § Y\n;;;\nA; second ;d.md\nB;;x.md;\n')
    got = files.ground_truth(spark, str(p), source_rows=10).orderBy("pos").collect()
    assert [(r.id, r.question, r.files, r.sections) for r in got] == [
        ("A", 'multi\nline "q"', ["a, b.md", "c.md"], ["12 § X", "13 § Y"]), ("A.2", "second", ["d.md"], [])]


def test_judged_collection(spark, tmp_path):
    spark.createDataFrame([("d1", "t", " "), ("d2", None, "T")], "id string, text string, title string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("q1", "x"), ("q2", "y")], "id string, text string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 0)], "`query-id` string, `corpus-id` string, score int").write.parquet(str(tmp_path / "r"))
    docs, questions, gold = files.judged_collection(spark, *[str(tmp_path / n) for n in "cqr"])
    assert {(r.doc_id, r.title, r.text) for r in docs.collect()} == {("d1", "d1", "t"), ("d2", "T", "")}
    assert [r.query_id for r in questions.collect()] == ["q1"] and gold.count() == 1


def test_messages(spark, tmp_path):
    spark.createDataFrame([("hi", 1), ("yo", 0)], "text string, intent long").coalesce(1).write.parquet(str(tmp_path / "m"))
    got = files.labelled_messages(spark, str(tmp_path / "m"), "te", "intent", {0: "no", 1: "yes"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("te0", "hi", "yes"), ("te1", "yo", "no")]
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write('{"id": "3", "text": "a", "label": "b"}\n\n')
    assert [tuple(r) for r in files.json_messages(spark, str(tmp_path / "m.json.gz"), "tr").collect()] == [("tr3", "a", "b")]


def test_footer_names(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    meta = {"huggingface": json.dumps({"info": {"features": {"intent": {"names": ["x", "y"]}}}})}
    pq.write_table(pa.table({"a": [1]}).replace_schema_metadata(meta), tmp_path / "f.parquet")
    assert files.footer_label_names(str(tmp_path / "f.parquet"), "intent") == {0: "x", 1: "y"}


def test_suite_and_tool(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "query_one.json").write_text(json.dumps(
        {"query": "q", "keywords": ["k"], "matches": [{"file": "a.c", "start_line": 3, "end_line": 9, "symbol": "s", "reason": "r"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"one": "yksi"}))
    cases = files.suite_cases(spark, str(tmp_path / "repo" / "query_*.json"), str(tmp_path / "t.json"))
    assert [(r.repo, r.name, r.query, r.translated) for r in cases.collect()] == [("repo", "one", "q", "yksi")]
    assert [tuple(r) for r in files.case_regions(cases).collect()] == [("repo__one", "a.c", 3, 9)]
    (tmp_path / "repo__one.json").write_text(json.dumps(
        {"hits": [{"path": "a\\b.c", "confidence": None, "ranges": [{"start": 1, "end": 4, "p": None}, {"start": 6, "end": 8, "p": 0.5}]}],
         "stats": {"input_tokens": 7}, "wall_s": 1.5}))
    res = files.tool_results(spark, str(tmp_path / "repo__*.json"))
    assert [(r.query_id, r.doc_id, r.pos, r.start_line, r.p) for r in files.tool_ranges(res).orderBy("pos").collect()] == [
        ("repo__one", "a/b.c", 0, 1, None), ("repo__one", "a/b.c", 1, 6, 0.5)]
    (tmp_path / "s.json").write_text(json.dumps({"scores": {"q1": {"7": 0.25}}}))
    assert [tuple(r) for r in files.precomputed_scores(spark, str(tmp_path / "s.json")).collect()] == [("q1", 7, 0.25)]


def answer(todo):
    return todo.select("id", F.lit("g").alias("gold"), F.lit("p").alias("pred"), F.lit(0.5).alias("conf"))


def test_prediction_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"id": "a", "error": "x"}, {"id": "b", "gold": "g", "pred": "p", "conf": 0.3, "p_pred": None, "top": [["l", 0.5]]},
            {"id": "a", "gold": "g", "pred": "q", "conf": 0.9}, {"id": "a", "error": "late"}]
    (log / "part.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r.id: r for r in results.read_predictions(spark, str(log)).collect()}
    assert got["a"].pred == "q" and got["a"].conf == 0.9 and got["a"].pos < got["b"].pos
    assert got["b"].conf is None and got["b"].top[0].p == 0.5
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert results.append_predictions(todo, str(log), answer) == 1
    assert results.append_predictions(todo, str(log), answer) == 0


def test_stream_resumes(spark, tmp_path):
    inbox, log = tmp_path / "in", tmp_path / "log"
    inbox.mkdir()
    for name, ids in (("1", "ab"), ("2", "bc")):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        q = answer_new_work(spark, str(inbox), "id string", str(log), str(tmp_path / "ck"), answer)
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(str(log)).collect()) == ["a", "b", "c"]


def test_vector_cache(spark, tmp_path):
    asked = []

    def vectorise(d):
        asked.append(d.count())
        return d.select("key", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vec"))

    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "id long, text string")
    path = str(tmp_path / "cache")
    assert sorted((r.id, r.vec) for r in results.cached_vectors(texts, path, vectorise, 2).collect()) == [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0])]
    more = texts.unionByName(spark.createDataFrame([(4, "cc")], "id long, text string"))
    assert results.cached_vectors(more, path, vectorise, 2).count() == 4 and asked == [2, 1]
    with pytest.raises(ValueError):
        results.cached_vectors(more, path, vectorise, 3)


def test_shortlist_cache_and_append(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, 5)], "query_id long, chunk_id long")

    args = (str(tmp_path / "s"), 30)
    for _ in range(2):
        assert results.cached_shortlists(*args, 1, build, spark).count() == 1
    results.cached_shortlists(*args, 1, build, spark, refresh=True)
    assert len(built) == 2
    with pytest.raises(ValueError):
        results.cached_shortlists(*args, 2, build, spark)
    old = spark.createDataFrame([("a", 30, 1, 0.1), ("b", 30, 1, 0.2)], "strategy string, k int, n_queries int, v double")
    new = spark.createDataFrame([("b", 30, 1, 0.9)], "strategy string, k int, n_queries int, v double")
    assert {(r.strategy, r.v) for r in results.append_strategies(old, new).collect()} == {("a", 0.1), ("b", 0.9)}
    with pytest.raises(ValueError):
        results.append_strategies(old, new.withColumn("k", F.lit(10)))


def test_run_files_and_report(spark, tmp_path):
    run = spark.createDataFrame([("s", "secret", 0.5)], "strategy string, question string, r1 double")
    results.write_run(run, str(tmp_path), "2026", publishable=False)
    assert set(spark.read.json(str(tmp_path / "latest")).columns) == {"strategy", "r1"}
    assert results.markdown_table(run).splitlines()[2] == "| s | secret | 0.500 |"
    with pytest.raises(ValueError):
        results.markdown_table(spark.range(5), limit=2)


def test_commands(spark):
    docs = spark.createDataFrame([(1, "t", "alpha beta gamma delta " * 5), (2, "u", "omega sigma kappa " * 5)], "doc_id long, title string, text string")
    qs = spark.createDataFrame([(1, "beta gamma"), (2, "kappa")], "query_id long, question string")
    gold = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, doc_id long")
    chunks = api.prepare(docs)
    short = api.retrieve(chunks, qs, ("fts", "hybrid"))
    lists = short.withColumn("doc_id", F.expr(f"chunk_id div {chunking.ID_SHIFT}")).withColumnRenamed("stage", "strategy")
    assert {(r.strategy, r.hit_at_1) for r in api.evaluate(lists, gold, qs, []).collect()} == {("fts", 1.0), ("hybrid", 1.0)}
    ranked = api.rerank(short.where("stage = 'hybrid'").drop("stage"), chunks, qs, rerank.overlap_scorer())
    assert ranked.where("rank = 1").count() == 2
