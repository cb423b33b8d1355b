"""Ranking quality. Input lists are short (the shortlist depth); groups are one question each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.text import section_relevant
from rankloom.operators.prefix import running

DEPTHS = (1, 3, 5, 10)
NOT_FOUND = 999


def flag_relevant(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds boolean ``rel`` by (query_id, doc_id) membership in ``gold``."""
    marked = gold.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(True))
    return ranked.join(marked, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))


def flag_sections(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranked(query_id, doc_id, heading, heading_path, ...)`` with ``rel_doc`` and ``rel_section``.

    ``gold(query_id, doc_id, sections)``: a chunk answers at document level if its document is gold, and at section
    level if it also lies in one of the document's gold sections.
    """
    held = ranked.join(gold.select("query_id", "doc_id", "sections"), ["query_id", "doc_id"], "left")
    inside = section_relevant(F.col("sections"), F.col("heading"), F.col("heading_path"))
    return held.withColumns({"rel_doc": F.col("sections").isNotNull(), "rel_section": F.coalesce(inside, F.lit(False))}).drop("sections")


def by_level(flagged: DataFrame) -> DataFrame:
    """Rows of ``flag_sections`` once for each ``level`` with its ``rel``."""
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"rel_{n}").alias("rel")) for n in ("doc", "section")])
    return flagged.withColumn("_l", F.explode(levels)).select("*", "_l.*").drop("_l", "rel_doc", "rel_section")


def nearest_headings(gold: DataFrame, chunks: DataFrame, keep: int = 3) -> DataFrame:
    """``gold(query_id, doc_id, sections)`` without any section among the document's chunks, with up to ``keep`` headings
    that hold the first content word (over four characters) of the first section, in document order.

    Chunks meet their gold document only; a window limited to ``keep`` rows bounds what is gathered.
    """
    word = F.lower(F.get(F.split(F.regexp_replace(F.coalesce(F.get("sections", F.lit(0)), F.lit("")), "^\\d+[.\\s§]*", ""), "\\s+"), F.lit(0)))
    asked = gold.select("query_id", "doc_id", "sections", word.alias("_word"))
    pool = asked.join(chunks.select("doc_id", "ordinal", "heading", "heading_path"), "doc_id", "left")
    hit = F.coalesce(section_relevant(F.col("sections"), F.col("heading"), F.col("heading_path")), F.lit(False))
    lost = pool.groupBy("query_id").agg(F.max(hit).alias("_hit")).where(~F.col("_hit")).select("query_id")
    near = (F.length("_word") > 4) & F.contains(F.lower("heading"), F.col("_word"))
    order = Window.partitionBy("query_id").orderBy("doc_id", "ordinal")
    first = pool.where(near).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "heading"))).alias("_h"))
    empty = F.array().cast("array<string>")
    return lost.join(listed, "query_id", "left").select("query_id", F.coalesce(F.transform("_h", lambda x: x["heading"]), empty).alias("nearest"))


def query_metrics(flagged: DataFrame, keys: list[str], cfg: Config = DEFAULTS, top_score: bool = False) -> DataFrame:
    """First relevant rank, hit at depths, reciprocal rank and binary nDCG per list.

    The nDCG ideal is taken over the relevant items in the list itself. ``top_score`` adds the
    score of the first candidate.
    """
    extra = [F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score")] if top_score else []
    k = cfg.eval_k
    gain = F.when(F.col("rel") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    agg = flagged.groupBy(*keys).agg(
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first_rank"),
        F.count_if("rel").alias("n_rel"),
        F.sum(gain).alias("dcg"),
        *extra,
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_rel").cast("int")), F.lit(1))),
        F.lit(0.0).cast("double"),
        lambda a, i: a + 1.0 / F.log2(i + 1.0),
    )
    first = F.col("first_rank")
    return agg.select(
        *keys,
        "first_rank",
        *[F.coalesce(first <= d, F.lit(False)).cast("int").alias(f"hit_at_{d}") for d in DEPTHS],
        F.round(F.when(first <= k, 1.0 / first).otherwise(0.0), 9).alias("rr"),
        F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0), 9).alias("ndcg"),
        *(["top_score"] if top_score else []),
    )


def keep_empty(metrics: DataFrame, questions: DataFrame, strategies: list[str] | DataFrame) -> DataFrame:
    """A question whose list is empty scores zero instead of vanishing.

    ``strategies``: their names, or a frame with the column ``strategy``; every question meets every one, as
    the means over questions need.
    """
    if isinstance(strategies, DataFrame):
        base = questions.select("query_id").join(strategies.select("strategy"))
    else:
        base = questions.select("query_id", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    return fill_empty(base, metrics)


def fill_empty(base: DataFrame, metrics: DataFrame) -> DataFrame:
    """``metrics`` for every (strategy, query_id) of ``base``; a list that is missing scores zero."""
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in metrics.columns if c.startswith("hit_at_")}
    return base.join(metrics, ["strategy", "query_id"], "left").select(
        "strategy", "query_id", "first_rank", *zero.values(),
        F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"),
        *[c for c in metrics.columns if c == "top_score"],
    )


def aggregate_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(f"hit_at_{d}"), 9).alias(f"hit_at_{d}") for d in DEPTHS],
        F.round(F.avg("rr"), 9).alias("mrr"),
        F.round(F.avg("ndcg"), 9).alias("ndcg"),
    )


def ceiling(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Share of questions whose list holds anything relevant: no reordering can beat it."""
    found = F.col("first_rank").isNotNull().cast("double")
    return metrics.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(found), 9).alias("ceiling"))


def paired_ranks(per_query: DataFrame, baseline: str) -> DataFrame:
    """First relevant rank before (the ``baseline`` strategy) and after, for every other strategy.

    A question has one row per strategy, so the baseline is read inside its group instead of by a self-join.
    """
    rank = F.coalesce("first_rank", F.lit(NOT_FOUND))
    base = F.max(F.when(F.col("strategy") == baseline, rank)).over(Window.partitionBy("query_id"))
    return per_query.select("strategy", "query_id", base.alias("before"), rank.alias("after")).where(F.col("strategy") != baseline)


def movement(pair: DataFrame) -> DataFrame:
    """Questions moved up, down or not, per strategy."""
    return pair.groupBy("strategy").agg(
        F.count_if(F.col("after") < F.col("before")).alias("moved_up"),
        F.count_if(F.col("after") > F.col("before")).alias("moved_down"),
        F.count_if(F.col("after") == F.col("before")).alias("unchanged"),
    )


def outcome(pair: DataFrame) -> DataFrame:
    """Rescued (to first from below third), broken (first lost) and missed questions."""
    a, b = F.col("after"), F.col("before")
    kind = (
        F.when((a == 1) & (b > 3), "rescued")
        .when((b == 1) & (a > 1), "broken")
        .when((b == NOT_FOUND) & (a == NOT_FOUND), "missed")
    )
    return pair.withColumn("outcome", kind).where(F.col("outcome").isNotNull())


# Thresholds for probability-like and for rubric-level scores.
PROBABILITY_STEPS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 0.9]
RUBRIC_STEPS = [0.0, 1.0, 1.5, 2.0, 2.5, 3.0]


def abstention(tops: DataFrame) -> DataFrame:
    """``tops(strategy, query_id, top_score, first_rank)``: share answered and precision per threshold.

    The scale follows from the strategy's highest score. Strategies without scores give no rows.
    Both scales are counted with partial sums, every group sees all rows of its strategy, and
    the scale that applies is kept afterwards, so nothing is joined on the strategy.
    """
    steps = [F.struct(F.lit(rubric).alias("rubric"), F.lit(t).alias("threshold"))
             for rubric, scale in ((False, PROBABILITY_STEPS), (True, RUBRIC_STEPS)) for t in scale]
    met = F.coalesce(F.col("top_score") >= F.col("t.threshold"), F.lit(False))
    counted = tops.select("strategy", "top_score", "first_rank", F.explode(F.array(*steps)).alias("t")).groupBy(
        "strategy", F.col("t.rubric").alias("rubric"), F.col("t.threshold").alias("threshold")
    ).agg(
        F.max("top_score").alias("high"), F.count("*").alias("evaluable"),
        F.count_if(met).alias("answered_n"), F.count_if(met & (F.col("first_rank") == 1)).alias("right_n"),
    )
    return counted.where(F.col("high").isNotNull() & (F.col("rubric") == (F.col("high") > 1.5))).select(
        "strategy", "threshold",
        F.round(F.col("answered_n") / F.col("evaluable"), 9).alias("answered"),
        F.round(F.coalesce(F.try_divide("right_n", "answered_n"), F.lit(0.0)), 9).alias("precision"),
    )


def rank_values(values: DataFrame, keys: list[str], value: str, source_rows: int | None = None) -> DataFrame:
    """Distinct values per group with the positions they span and the group size.

    The histogram is built before any ordering, so equal values are pre-aggregated in every
    task; the running count spreads over partitions unless ``source_rows`` proves it small.
    """
    hist = values.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    sizes = hist.groupBy(*keys).agg(F.sum("_c").alias("n"))
    spans = running(hist, keys, [F.col(value)], {"_upto": F.col("_c")}, source_rows)
    return spans.join(sizes, keys).withColumn("_below", F.col("_upto") - F.col("_c"))


def value_at(value: str, rank: Column) -> Column:
    """Aggregate: the value whose span of positions covers the 1-based ``rank``."""
    return F.min(F.when((F.col("_upto") >= rank) & (F.col("_below") < rank), F.col(value)))


def nearest_rank_percentiles(values: DataFrame, keys: list[str], value: str, points=(50, 95),
                             source_rows: int | None = None) -> DataFrame:
    """Nearest-rank (ceiling) percentiles."""
    ranked = rank_values(values, keys, value, source_rows)
    at = {p: F.greatest(F.ceil(F.lit(p) * F.col("n") / 100), F.lit(1)) for p in points}
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), *[value_at(value, r).alias(f"p{p}") for p, r in at.items()]
    )


def lower_index_percentiles(values: DataFrame, keys: list[str], value: str,
                            source_rows: int | None = None) -> DataFrame:
    """Percentiles by 0-based index n//2 and floor(0.95 n), and the averaging median."""
    ranked = rank_values(values, keys, value, source_rows)
    n = F.col("n")
    mid, high = F.floor(n / 2) + 1, F.least(F.floor(n * 95 / 100) + 1, n)
    lower = F.floor((n + 1) / 2)
    out = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        value_at(value, mid).alias("p50_index"),
        value_at(value, high).alias("p95_index"),
        value_at(value, lower).alias("_low"),
    )
    return out.select(*keys, "n", "p50_index", "p95_index", F.round((F.col("_low") + F.when(
        F.col("n") % 2 == 0, F.col("p50_index")).otherwise(F.col("_low"))) / 2, 9).alias("median"))
