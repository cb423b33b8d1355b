"""The study's commands as plain functions over DataFrames.

documents(doc_id, title, text) · questions(query_id, question) · gold(query_id, doc_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.text import passage_text
from rankloom.operators import chunking, classify, dense, fusion, hybrid, metrics, rerank as rr


def prepare(documents: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Chunks; cut in the scan, wherever they are needed."""
    return chunking.document_chunks(documents, cfg)


def retrieve(chunks: DataFrame, questions: DataFrame, stages: tuple[str, ...] = ("fts", "vector", "hybrid"),
             candidates: int | None = None, limit: int | None = None, cfg: Config = DEFAULTS) -> DataFrame:
    """Shortlists per first stage. ``limit`` takes the first questions by id, for a smoke run."""
    asked = questions if limit is None else questions.orderBy("query_id").limit(limit)
    return hybrid.shortlists(chunks, asked, list(stages), candidates, cfg)


def rerank(shortlist: DataFrame, chunks: DataFrame, questions: DataFrame, scorer: rr.Scorer) -> DataFrame:
    pairs = shortlist.drop("score").join(chunks, "chunk_id").join(questions, "query_id").withColumn(
        "passage", passage_text(F.col("title"), F.lit(""), F.col("body"))
    )
    return rr.rerank(pairs, scorer).drop("passage", "body", "question")


def evaluate(lists: DataFrame, gold: DataFrame, questions: DataFrame, strategies: list[str], cfg: Config = DEFAULTS) -> DataFrame:
    """Means per strategy of ``lists(strategy, query_id, doc_id, rank)``; an empty ``strategies`` means all."""
    names = strategies or lists.select("strategy").distinct()
    wanted = lists.where(F.col("strategy").isin(strategies)) if strategies else lists
    flagged = metrics.flag_relevant(wanted, gold)
    per_query = metrics.keep_empty(metrics.query_metrics(flagged, ["strategy", "query_id"], cfg), questions, names)
    return metrics.aggregate_metrics(per_query, ["strategy"])


def fuse(scores: DataFrame, method: str, cfg: Config = DEFAULTS) -> DataFrame:
    return fusion.fuse(scores, method, cfg)


def classify_vectors(train: DataFrame, test: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """kNN vote and label-mean softmax predictions of ``test(id, label, vec)``."""
    near = classify.neighbours(train, test, cfg.neighbours, cfg)
    return classify.knn_vote(near, test).unionByName(
        classify.zero_shot(test, dense.centroids(train, "label", "vec"), cfg=cfg)
    )
