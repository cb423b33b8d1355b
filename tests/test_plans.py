"""The shape of the physical plans, without running them."""

import re

import pytest

import __spark_entry__ as entry
from rankloom.plans.study import Study


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)\(?([^,)\[]*)", text)


LEARNED = {"tfidf_lr", "emb_lr", "lsh_topk"}


@pytest.mark.parametrize("name", ["hybrid_rrf", "bm25_topk", "verbatim_gold", "fusion_grid_devtest", "region_recall", "heldout_gate",
                                  "abstention_curve", "movement", "section_mask", "distractor_pool"])
def test_no_cross_joins(spark, data, name):
    text = plan(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_exchange_carries_text(spark, data, monkeypatch):
    """Cutting and tokenising stay in the scan; what moves are postings of asked terms, by block, and the best units."""
    from rankloom import session

    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    study = Study(spark, data)
    assert "Exchange" not in plan(study.chunks) and "Exchange" not in plan(study.line_windows) and "Exchange" not in plan(study.page_chunks())
    text = plan(entry.queries()["lexical_weighted_topk"](spark, data))
    keys = {k.split("#")[0] for kind, k in exchanges(text) if kind == "hashpartitioning"}
    assert keys == {"block", "query_id"} and "WindowGroupLimit" in text
    assert {"term", "block"} <= set(re.findall(r"ReadSchema: struct<([^>]*)", text)[0].replace(":", ",").split(","))
    vectors = plan(entry.queries()["hashed_vector_topk"](spark, data))
    assert {k.split("#")[0] for _, k in exchanges(vectors)} == {"query_id"}


def test_small_tables_are_dealt_and_large_ones_are_not(spark, data, monkeypatch):
    from rankloom import session

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert "Exchange" in plan(session.spread(docs, "doc_id"))
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    assert "Exchange" not in plan(session.spread(docs, "doc_id"))


def test_scans_read_only_what_they_need(spark, data):
    text = plan(entry.queries()["resume_todo"](spark, data))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {"doc_id:bigint,lang:string", "doc_id:bigint"} == set(schemas)
    text = plan(entry.queries()["positive_labels"](spark, data))
    assert "GreaterThan(quality,0)" in text


def test_row_local_chunking_has_no_shuffle(spark, data, monkeypatch):
    from rankloom import session

    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    for name in ("doc_windows", "line_windows", "markdown_chunks", "heading_outline", "heading_match", "parse_labels"):
        text = plan(entry.queries()[name](spark, data))
        assert "Exchange" not in text and "Python" not in text, name


def test_broadcast_needs_a_proven_bound(spark, data):
    from rankloom.session import broadcast_checked, broadcast_within

    df = spark.range(10)
    other = spark.range(100).withColumnRenamed("id", "k")
    hinted = lambda d: "BroadcastHashJoin" in plan(other.join(d, other.k == d.id)) and "hint" in str(
        d._jdf.queryExecution().logical().toString().lower())
    assert hinted(broadcast_within(df, 10)) and not hinted(broadcast_within(df, 11, limit=10))
    assert hinted(broadcast_checked(df, df)) and not hinted(broadcast_checked(df, df, limit=9))


def test_oversized_terms_are_shuffled_not_broadcast(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = {tuple(r) for r in entry.queries()["lexical_weighted_topk"](spark, data).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert want == {tuple(r) for r in entry.queries()["lexical_weighted_topk"](spark, data).collect()}


def test_study_is_lazy_about_tables(spark, data):
    assert Study(spark, data).questions.columns == ["query_id", "question"]
