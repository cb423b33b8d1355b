"""Line ranges: overlap, coverage, budgets and file/region recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def passage_regions(docs: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Line range (1-based, inclusive) that holds the question text inside each gold document."""
    pairs = gold.join(questions, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    at = F.instr("text", F.col("question"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    start = breaks(F.substring(F.col("text"), F.lit(1), at - 1)) + 1
    return pairs.select(
        "query_id", "doc_id", start.alias("start_line"), (start + breaks(F.col("question"))).alias("end_line")
    )


def touched_regions(regions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Regions with ``touched``: some returned range of the same question and file overlaps.

    The file key makes it an equi-join; ranges per (question, file) are few.
    """
    r = ranges.select("query_id", "doc_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    overlaps = (F.col("a") <= F.col("end_line")) & (F.col("start_line") <= F.col("b"))
    key = ["query_id", "doc_id", "start_line", "end_line"]
    return (
        regions.join(r, ["query_id", "doc_id"], "left")
        .groupBy(*key)
        .agg(F.max(F.coalesce(overlaps, F.lit(False))).alias("touched"))
    )


def region_recall(regions: DataFrame, ranges: DataFrame) -> DataFrame:
    return touched_regions(regions, ranges).groupBy("query_id").agg(
        F.count("*").alias("n_regions"), F.round(F.avg(F.col("touched").cast("double")), 9).alias("region_recall")
    )


def file_ranks(windows: DataFrame) -> DataFrame:
    """Files in order of their best window."""
    best = windows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best")
    return best.withColumn("file_rank", F.row_number().over(w))


def file_recall(gold: DataFrame, files: DataFrame, depths=(1, 5, 10)) -> DataFrame:
    """Share of the gold files among the first files; true recall per question."""
    found = gold.select("query_id", "doc_id").join(files, ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(
        F.count("*").alias("n_gold"),
        *[
            F.round(F.count_if(F.col("file_rank") <= d) / F.count("*"), 9).alias(f"file_recall_at_{d}")
            for d in depths
        ],
    )


def file_recall_at_budget(gold: DataFrame, files: DataFrame, budget: DataFrame) -> DataFrame:
    """Recall when each question may return as many files as ``budget(query_id, n)`` allows, at least one."""
    found = gold.select("query_id", "doc_id").join(files, ["query_id", "doc_id"], "left").join(budget, "query_id", "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return found.groupBy("query_id").agg(
        F.max(n).cast("long").alias("n_files"),
        F.round(F.count_if(F.col("file_rank") <= n) / F.count("*"), 9).alias("file_recall_at_n"),
    )


def best_ranges(ranges: DataFrame, keep: int = 3) -> DataFrame:
    """Per hit the ranges with the highest ``p`` (missing counts as 0), ties by position."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.coalesce("p", F.lit(0.0)).desc(), "pos")
    return ranges.withColumn("range_rank", F.row_number().over(w)).where(F.col("range_rank") <= keep)


def covered_lines(ranges: DataFrame) -> DataFrame:
    """Distinct lines covered per question: overlapping ranges are counted once, without listing lines."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("start_line", "end_line")
    upto = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("end_line") - F.greatest(F.col("start_line") - 1, F.coalesce(F.col("_upto"), F.lit(0)))
    return (
        ranges.withColumn("_upto", upto)
        .groupBy("query_id")
        .agg(F.sum(F.greatest(fresh, F.lit(0))).cast("long").alias("lines"))
    )


def budget_prefix(windows: DataFrame, budget: DataFrame, floor: int = 80) -> DataFrame:
    """Windows in rank order until the next would exceed the question's line budget."""
    size = F.col("end_line") - F.col("start_line") + 1
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.greatest(F.coalesce("lines", F.lit(0)), F.lit(floor))
    return (
        windows.withColumn("used", F.sum(size).over(w))
        .join(budget, "query_id", "left")
        .where(F.col("used") <= limit)
        .drop("lines")
    )
