"""Result stores: append logs, cached vectors and shortlists, stamped runs and small reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.corpus import last_success, unfinished

PREDICTION = (
    "id string, gold string, pred string, conf double, p_pred double, top array<array<string>>, ms double, "
    "in_tok bigint, out_tok bigint, usd double, model string, raw string, error string, attempt bigint"
)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block, line)``: every line with its place. Lines of one file follow each other by (block, line); the
    names of part files say nothing about the order in which they were appended, which ``attempt`` in the rows does."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("line"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction log with one row per id (last success, else first failure), in first-seen order ``pos``.

    The order is that of attempts, then of lines. Rows of a log that was written without attempts are all of the first one.

    The raw ``top`` pairs mix strings and numbers; they come back as (label, p). A present
    ``p_pred``, even null, wins over ``conf``.
    """
    has_p = F.col("value").contains('"p_pred"')
    place = F.struct(F.coalesce("r.attempt", F.lit(0)).alias("attempt"), "file", "block", "line").alias("line")
    lines = log_lines(spark, path).where(F.length(F.trim("value")) > 0)
    rows = lines.select("*", has_p.alias("has_p"), F.from_json("value", PREDICTION).alias("r")).select(place, "has_p", "r.*").drop("attempt")
    one = last_success(rows, "id", "line", F.coalesce(F.length("error") > 0, F.lit(False)))
    pairs = F.transform("top", lambda t: F.struct(t[0].alias("label"), t[1].cast("double").alias("p")))
    return one.withColumn("top", pairs).withColumn("conf", F.when(F.col("has_p"), F.col("p_pred")).otherwise(F.col("conf"))).drop("has_p", "line")


def append_predictions(todo: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame], key: str = "id") -> int:
    """Answer only the ids without a success so far and append them as the next attempt; returns how many were left to do.

    Files only appear in the log when the whole batch is written, so a batch that failed leaves nothing, and one that is
    run again finds its ids done.
    """
    spark, attempt = todo.sparkSession, 1
    if _exists(spark, path):
        done = read_predictions(spark, path).where(F.col("error").isNull()).select(F.col("id").alias(key))
        todo, attempt = unfinished(todo, done, key), last_attempt(spark, path) + 1
    left = todo.count()
    if left:
        answer(todo).withColumn("attempt", F.lit(attempt)).write.mode("append").json(path)
    return left


def last_attempt(spark: SparkSession, path: str) -> int:
    """The number of the newest attempt in a log, 0 for one without attempts."""
    return spark.read.schema("attempt bigint").json(path).agg(F.max("attempt")).first()[0] or 0


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_vectors(texts: DataFrame, path: str, vectorise: Callable[[DataFrame], DataFrame], dims: int) -> DataFrame:
    """``texts(id, text)`` with ``vec``: vectors are kept by content, so equal texts cost one call.

    ``vectorise`` maps (key, text) to (key, vec). A cached vector of another length is refused.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", F.sha2("text", 256))
    missing = keyed.select("key", "text").dropDuplicates(["key"])
    if _exists(spark, path):
        have = spark.read.parquet(path)
        if have.where(F.size("vec") != dims).limit(1).count():
            raise ValueError(f"{path} holds vectors of another size than {dims}")
        missing = unfinished(missing, have, "key")
    if not missing.isEmpty():
        vectorise(missing).select("key", "vec").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["key"]), "key").drop("key")


def cached_shortlists(path: str, k: int, questions: int, build: Callable[[], DataFrame], spark: SparkSession,
                      refresh: bool = False) -> DataFrame:
    """Shortlists kept per depth; a stored set for fewer questions is refused, not silently reused."""
    at = f"{path.rstrip('/')}/k={k}"
    if refresh or not _exists(spark, at):
        build().write.mode("overwrite").parquet(at)
    kept = spark.read.parquet(at)
    have = kept.select("query_id").distinct().count()
    if have < questions:
        raise ValueError(f"{at} covers {have} of {questions} questions; refresh it")
    return kept


def append_strategies(earlier: DataFrame, fresh: DataFrame, settings: list[str] = ("k", "n_queries")) -> DataFrame:
    """Keep the strategies a new run did not repeat; refuse runs made with other settings."""
    for name in settings:
        values = earlier.select(name).unionByName(fresh.select(name)).distinct().limit(2).count()
        if values > 1:
            raise ValueError(f"runs differ in {name}")
    again = fresh.select("strategy").distinct()
    return earlier.join(again, "strategy", "left_anti").unionByName(fresh)


PRIVATE_COLUMNS = ["question", "files", "sections", "answer"]


def write_run(run: DataFrame, path: str, stamp: str, publishable: bool = True) -> None:
    """A stamped copy and ``latest``; a set that may not be published loses its texts first."""
    kept = run if publishable else run.drop(*PRIVATE_COLUMNS)
    kept.write.mode("errorifexists").json(f"{path}/{stamp}")
    kept.write.mode("overwrite").json(f"{path}/latest")


def assemble_run(strategies: DataFrame, scores: DataFrame) -> DataFrame:
    """One nested record per (strategy, question): settings, metrics and its scored candidates.

    Candidates are bounded by the shortlist depth.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    nested = scores.groupBy("strategy", "query_id").agg(listed.alias("scores"))
    return strategies.join(nested, ["strategy", "query_id"], "left")


def save_tables(tables: dict[str, DataFrame], namespace: str, buckets: int = 16, keys: dict[str, str] | None = None) -> None:
    """Load a data set into its own namespace; tables with a key are bucketed by it for co-located joins."""
    for name, df in tables.items():
        spark = df.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`")
        writer = df.write.mode("overwrite").format("parquet")
        if keys and name in keys:
            writer = writer.bucketBy(buckets, keys[name]).sortBy(keys[name])
        writer.saveAsTable(f"{namespace}.{name}")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregated frame as a markdown table. More than ``limit`` rows is not a report."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + [f"| {' | '.join(show(v) for v in r)} |" for r in rows])


def chart_values(wanted: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Values for a chart in the asked order; a strategy that was not run keeps a NULL."""
    return wanted.join(metrics, keys, "left")
