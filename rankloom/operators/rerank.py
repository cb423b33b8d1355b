"""Reordering shortlists by scores from outside.

A scorer is any function from ``pairs(query_id, chunk_id, rank, question, passage)`` to the
same rows plus ``score`` (NULL = the judge failed). Shortlist membership never changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.text import code_tokens

Scorer = Callable[[DataFrame], DataFrame]


def by_score(pairs: DataFrame, before: str = "rank", out: str = "rank") -> DataFrame:
    """Stable order per question: score descending, unscored last, then the earlier position."""
    w = Window.partitionBy("query_id").orderBy(
        F.col("score").isNull(), F.col("score").desc(), F.col(before)
    )
    return pairs.withColumn("_new", F.row_number().over(w)).drop(out if out != before else before).withColumnRenamed("_new", out)


def overlap_share(question, passage):
    """Share of the distinct question tokens found in the passage."""
    q, p = F.array_distinct(code_tokens(question)), F.array_distinct(code_tokens(passage))
    return F.round(F.try_divide(F.size(F.array_intersect(q, p)), F.size(q)), 6)


def measured(pairs: DataFrame) -> DataFrame:
    """Replace the wide texts by what the local judges and the accounting need of them.

    Done once before any reordering, so passages are read where they lie and never shuffled.
    """
    return pairs.withColumns({
        "overlap": overlap_share(F.col("question"), F.col("passage")),
        "passage_chars": F.length("passage"), "question_chars": F.length("question"),
    }).drop("question", "passage")


def overlap_scorer(min_chars: int = 0) -> Scorer:
    """Local deterministic judge; passages shorter than ``min_chars`` count as failed requests."""

    def score(pairs: DataFrame) -> DataFrame:
        known = pairs if "overlap" in pairs.columns else measured(pairs)
        return known.withColumn("score", F.when(F.col("passage_chars") >= min_chars, F.col("overlap")))

    return score


def graded_scorer(levels: int = 3) -> Scorer:
    def score(pairs: DataFrame) -> DataFrame:
        known = pairs if "overlap" in pairs.columns else measured(pairs)
        return known.withColumn("score", F.round(levels * F.col("overlap"), 4))

    return score


def in_batches(pairs: DataFrame, size: int, before: str = "rank") -> DataFrame:
    """Adds ``batch``: the request, counted from 0 in each question, that a candidate goes into, ``size`` to a request."""
    return pairs.withColumn("batch", F.floor((F.col(before) - 1) / size).cast("long"))


def batched_scorer(scorer: Scorer, size: int = DEFAULTS.batch_size, relative: bool = False) -> Scorer:
    """Candidates judged together, ``size`` to a request; the rows keep the ``batch`` they went into, which ``requests``
    accounts for. The scores are those of single requests, or, if ``relative``, shares of the best score in the request
    (NULL where that is zero)."""

    def score(pairs: DataFrame) -> DataFrame:
        judged = in_batches(scorer(pairs), size, "first_rank" if "first_rank" in pairs.columns else "rank")
        if not relative:
            return judged
        top = F.max("score").over(Window.partitionBy("query_id", "batch"))
        return judged.withColumn("score", F.round(F.try_divide(F.col("score"), top), 6))

    return score


def requests(judged: DataFrame, size: int, before: str = "rank") -> DataFrame:
    """One row for each request of a batched run over ``measured`` and scored candidates: how many candidates it held,
    how many got no answer, and its input size, the question counted once."""
    return in_batches(judged, size, before).groupBy("query_id", "batch").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("score").isNull()).alias("unanswered"),
        (F.sum("passage_chars") + F.max("question_chars")).cast("long").alias("input_units"))


def precomputed_scorer(table: DataFrame, missing: float | None = None) -> Scorer:
    """Scores looked up by (query_id, chunk_id). A question without rows keeps its order."""

    def score(pairs: DataFrame) -> DataFrame:
        found = pairs.join(table.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
        return found if missing is None else found.withColumn("score", F.coalesce("score", F.lit(missing)))

    return score


def rerank(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds ``score`` and moves ``rank`` to the new order; the old one stays as ``first_rank``."""
    return by_score(scorer(pairs.withColumn("first_rank", F.col("rank"))), before="first_rank", out="rank")


def judge_head(ranked: DataFrame, scorer: Scorer, keep: int, before: str = "rank") -> DataFrame:
    """The first ``keep`` by ``before`` judged and re-ordered, unanswered ones last; all others stay behind them, unscored."""
    head, tail = F.col(before) <= keep, F.col(before) > keep
    judged = scorer(ranked.where(head))
    rest = ranked.where(tail).withColumn("score", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id").orderBy(tail, F.col("score").isNull(), F.col("score").desc(), before)
    return judged.unionByName(rest, allowMissingColumns=True).withColumn("rank", F.row_number().over(w))


def cascade(pairs: DataFrame, cheap: Scorer, precise: Scorer, keep: int = DEFAULTS.cascade_keep) -> DataFrame:
    """Cheap pass over all, precise pass over the best ``keep`` alone; the tail keeps the cheap order, unscored."""
    first = rerank(pairs, cheap).withColumn("pass_rank", F.col("rank")).drop("score", "rank")
    return judge_head(first, precise, keep, "pass_rank").drop("pass_rank")


def judge_each(pairs: DataFrame, judges: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Several judge runs over one shortlist in one plan: rows per strategy with rank and score.

    Each run reorders the same partitioned rows, so the shortlist and its text are built once.
    """
    rows, parts = pairs.withColumn("first_rank", F.col("rank")), []
    for name, run in judges.items():
        done = run(rows.withColumn("rank", F.col("first_rank")))
        rows = done.withColumnsRenamed({"rank": f"rank_{name}", "score": f"score_{name}"})
        parts.append(F.struct(F.lit(name).alias("strategy"), F.col(f"rank_{name}").alias("rank"), F.col(f"score_{name}").alias("score")))
    drop = [f"{c}_{n}" for n in judges for c in ("rank", "score")]
    return rows.withColumn("_s", F.explode(F.array(*parts))).drop(*drop).select("*", "_s.*").drop("_s")


def usage(pairs: DataFrame, mode: str, cfg: Config = DEFAULTS) -> DataFrame:
    """Requests, failures and input size of a judge run over ``measured`` pairs, per question.

    ``mode``: ``single`` (one request per candidate), ``batched`` or ``cascade``. Input size is
    counted in characters, a stand-in for tokens; a batch sends the question once. ``rank`` is the
    order of the run's first pass; the second pass of a cascade adds its own requests and failures.
    """
    batches = F.ceil(F.count("*") / cfg.batch_size)
    passages = F.sum("passage_chars")
    question = F.max("question_chars")
    kept = F.least(F.count("*"), F.lit(cfg.cascade_keep))
    requests = {"single": F.count("*"), "batched": batches, "cascade": batches + kept}[mode]
    kept_chars = F.sum(F.when(F.col("rank") <= cfg.cascade_keep, F.col("passage_chars")).otherwise(0))
    again = kept_chars if mode == "cascade" else F.lit(0)
    failed = F.count_if(F.col("score").isNull())
    twice = F.count_if(F.col("score").isNull() & (F.col("rank") <= cfg.cascade_keep)) if mode == "cascade" else F.lit(0)
    return pairs.groupBy("query_id").agg(
        requests.cast("long").alias("requests"),
        (failed + twice).alias("failed"),
        (passages + question * requests + again).cast("long").alias("input_units"),
    )


def totals(used: DataFrame, usd_per_million: float) -> DataFrame:
    """Strategy totals from per-question usage with a ``strategy`` column."""
    usd = F.sum("input_units") / 1e6 * usd_per_million
    return used.groupBy("strategy").agg(
        F.count("*").alias("questions"),
        F.sum("requests").alias("requests"),
        F.sum("failed").alias("failed"),
        F.sum("input_units").alias("input_units"),
        F.round(usd, 9).alias("usd"),
        F.round(usd / F.count("*") * 1000, 9).alias("usd_per_1000"),
    )


def judge_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id").agg(F.count("score").alias("scored"), F.max("score").alias("top_score"))
