"""Reciprocal-rank fusion of ranked lists, and first-stage shortlists for a question set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.vectors import hashed_batches, hashed_vectors
from rankloom.operators.dense import nearest
from rankloom.operators.lexical import best_k, weighted_topk
from rankloom.session import stored


def merge_lists(lists: dict[str, DataFrame], cfg: Config = DEFAULTS) -> DataFrame:
    """Named lists of (query_id, chunk_id, rank, score) side by side, one row per listed chunk.

    ``score`` is the sum of 1/(constant + rank); each list's own rank and score sit in
    ``<name>_rank`` and ``<name>``, NULL where it lacks the chunk.
    """
    def votes(name):
        own = [F.when(F.lit(n == name), F.col(c)).alias(n + suffix)
               for n in lists for c, suffix in (("score", ""), ("rank", "_rank"))]
        return lists[name].select("query_id", "chunk_id", (1.0 / (cfg.rrf_k + F.col("rank"))).alias("w"), *own)

    own = [n + suffix for n in lists for suffix in ("", "_rank")]
    return reduce(DataFrame.unionByName, map(votes, lists)).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("w"), 12).alias("score"), *[F.max(c).alias(c) for c in own]
    )


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int, cfg: Config = DEFAULTS) -> DataFrame:
    return best_k(merge_lists(lists, cfg), k)


def lexical_list(chunks: DataFrame, questions: DataFrame, k: int, cfg: Config = DEFAULTS) -> DataFrame:
    return weighted_topk(chunks, questions, F.col("title"), F.col("body"), k, cfg=cfg)


def dense_list(chunks: DataFrame, questions: DataFrame, k: int, cfg: Config = DEFAULTS) -> DataFrame:
    collection, made = hashed_batches(chunks, ["chunk_id"], F.concat_ws("\n", "title", "body"))
    queries = hashed_vectors(questions, ["query_id"], F.col("question"))
    return nearest(queries, collection, k, cfg=cfg, made=made)


def shortlists(chunks: DataFrame, questions: DataFrame, stages: list[str], k: int | None = None,
               cfg: Config = DEFAULTS) -> DataFrame:
    """``(stage, query_id, rank, chunk_id, score)`` for the asked first stages.

    Only ids travel through ranking; text is joined to the short result by the caller. The lists are stored, which runs their
    searches on bounded batches and one after the other.
    """
    k = k or cfg.candidate_k
    depth = 2 * k
    if stages == ["fts"]:
        ranked = stored(lexical_list(chunks, questions, k, cfg))
    elif stages == ["vector"]:
        ranked = stored(dense_list(chunks, questions, k, cfg))
    else:
        lists = {"fts": stored(lexical_list(chunks, questions, depth, cfg)), "vector": stored(dense_list(chunks, questions, depth, cfg))}
        return _stages_of(merge_lists(lists, cfg), stages, k)
    return ranked.select(F.lit(stages[0]).alias("stage"), "query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "score")


def _stages_of(merged: DataFrame, stages: list[str], k: int) -> DataFrame:
    """Several stages from one pass over both lists; a question has at most a few hundred merged rows."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = merged.select("*", F.row_number().over(order).alias("hybrid_rank"), F.col("score").alias("hybrid"))
    rows = [
        F.struct(F.lit(n).alias("stage"), F.col(f"{n}_rank").cast("int").alias("rank"), F.col(n).alias("score")) for n in stages
    ]
    return ranked.select("query_id", "chunk_id", F.explode(F.array(*rows)).alias("s")).where(F.col("s.rank") <= k).select(
        "s.stage", "query_id", "s.rank", "chunk_id", "s.score"
    )
