"""Score fusion over long rows ``(query_id, chunk_id, first_rank, ranker, score)``.

``score`` is NULL where a ranker gave none. Every ranker has a row for every candidate.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS

METHODS = ("rrf", "combsum", "combmnz", "borda", "geometric", "max")
WEIGHTS = (0.25, 0.5, 2.0)
ABSENT_RANK = 1e6


def min_max(score: Column, keys: list[str]) -> Column:
    """Per-list scaling to [0,1]; a missing score counts as 0, a flat list gives zeros."""
    w = Window.partitionBy(*keys)
    s = F.coalesce(score, F.lit(0.0))
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.coalesce(F.try_divide(s - lo, hi - lo), F.lit(0.0))


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Adds ``norm`` and ``pos`` (rank by score, missing last, ties by candidate order) and list size."""
    keys = ["ranker", "query_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("score").isNull(), F.col("score").desc(), "first_rank")
    return scores.select(
        "*",
        min_max(F.col("score"), keys).alias("norm"),
        F.row_number().over(order).alias("pos"),
        F.count("*").over(Window.partitionBy(*keys)).alias("size"),
    )


def combine(method: str, norm: Column, pos: Column, size: Column, cfg: Config = DEFAULTS) -> Column:
    """The aggregate expression of one fusion rule."""
    return {
        "rrf": F.sum(1.0 / (cfg.rrf_k + F.coalesce(pos, F.lit(ABSENT_RANK)))),
        "combsum": F.sum(norm),
        "combmnz": F.sum(norm) * F.greatest(F.count_if(norm > 0.5), F.lit(1)),
        "borda": F.sum(size - pos).cast("double"),
        "geometric": F.product(norm + 0.01),
        "max": F.max(norm),
    }[method]


def fuse(scores: DataFrame, method: str, cfg: Config = DEFAULTS) -> DataFrame:
    """One fused list per question over all rankers present."""
    r = ranked_scores(scores)
    fused = r.groupBy("query_id", "chunk_id", "first_rank").agg(
        F.round(combine(method, F.col("norm"), F.col("pos"), F.col("size"), cfg), 9).alias("score")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_rank")
    return fused.select("query_id", "chunk_id", "score", F.row_number().over(w).alias("rank"))


def plan_grid(rankers: list[str]) -> list[tuple[int, str, str, dict[str, float]]]:
    """(position, label, method, weight per ranker) of every pair and triple, weighted pairs and singles."""
    grid: list[tuple[str, str, dict[str, float]]] = []
    for group in [*combinations(rankers, 2), *combinations(rankers, 3)]:
        for method in METHODS:
            grid.append((f"{method}({' + '.join(group)})", method, dict.fromkeys(group, 1.0)))
            if len(group) == 2 and method not in ("rrf", "borda"):
                grid += [
                    (f"{method}({group[0]}×{w:g} + {group[1]})", method, {group[0]: w, group[1]: 1.0}) for w in WEIGHTS
                ]
    grid += [(name, "combsum", {name: 1.0}) for name in rankers]
    return [(i, *g) for i, g in enumerate(grid)]


def _of_row(method: str, norms: list[Column], places: list[Column], size: Column, cfg: Config) -> Column:
    """One fusion rule over the rankers' values of a single candidate."""
    total = lambda xs: reduce(Column.__add__, xs)
    if method == "rrf":
        return total([1.0 / (cfg.rrf_k + F.coalesce(p, F.lit(ABSENT_RANK))) for p in places])
    if method == "borda":
        return total([size - p for p in places]).cast("double")
    if method == "geometric":
        return reduce(Column.__mul__, [n + 0.01 for n in norms])
    if method == "max":
        return norms[0] if len(norms) == 1 else F.greatest(*norms)
    if method == "combsum":
        return total(norms)
    strong = total([F.when(n > 0.5, 1).otherwise(0) for n in norms])
    return total(norms) * F.greatest(strong, F.lit(1))


def fuse_grid(scores: DataFrame, rankers: list[str], cfg: Config = DEFAULTS, carry: list[str] | None = None) -> DataFrame:
    """Every combination at once: ``(combo, query_id, chunk_id, rank)`` and the columns named in ``carry``.

    Scaled scores and places of all rankers are brought into one row for each candidate, every combination is an
    expression over that row, and one window ranks them. A weight multiplies the raw score before scaling, as the
    study defines it; scaling undoes a positive factor, so weighted variants equal their plain twin.
    """
    keys = ["query_id", "chunk_id", "first_rank", *(carry or [])]
    of = lambda name, c: F.max(F.when(F.col("ranker") == name, F.col(c))).alias(f"{c}_{name}")
    wide = ranked_scores(scores).groupBy(*keys).agg(F.max("size").alias("size"), *[of(n, c) for n in rankers for c in ("norm", "pos")])
    cells = [F.struct(F.lit(i).alias("combo"), F.round(_of_row(
        method, [F.col(f"norm_{n}") for n in weights], [F.col(f"pos_{n}") for n in weights], F.col("size"), cfg), 9).alias("score"))
        for i, _, method, weights in plan_grid(rankers)]
    fused = wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.combo", "c.score")
    w = Window.partitionBy("combo", "query_id").orderBy(F.col("score").desc(), "first_rank")
    return fused.select("combo", "query_id", "chunk_id", *(carry or []), F.row_number().over(w).alias("rank"))


def grid_names(rankers: list[str]) -> Column:
    """Combination number to (label, number of rankers) as a literal map."""
    entries = []
    for i, label, _, weights in plan_grid(rankers):
        entries += [F.lit(i), F.struct(F.lit(label).alias("label"), F.lit(len(weights)).alias("n_rankers"))]
    return F.create_map(*entries)


def held_out_verdict(grid: DataFrame) -> DataFrame:
    """Best single and best fusion by dev score (first of ties), with the test score of each.

    ``grid(combo, label, n_rankers, dev_r1, test_r1, test_mrr)``.
    """
    kind = F.when(F.col("n_rankers") == 1, "single").otherwise("fusion")
    best = F.min_by(F.struct("label", "dev_r1", "test_r1", "test_mrr"), F.struct(-F.col("dev_r1"), F.col("combo")))
    return grid.groupBy(kind.alias("kind")).agg(best.alias("b")).select(
        "kind", "b.label", "b.dev_r1", "b.test_r1", "b.test_mrr"
    )


def best_by_dev(grid: DataFrame, keep: int = 12) -> DataFrame:
    """The first ``keep`` combinations by dev score (ties in grid order), with ``place``. A grid has a few hundred rows."""
    order = Window.orderBy(F.col("dev_r1").desc_nulls_last(), "combo")
    return grid.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
