"""Corpus preparation: ground truth, distractors, resumable work and collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.operators.prefix import running

MASK32 = 0xFFFFFFFF
STEP = 0x6D2B79F5


def _mul32(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of two values below 2^32, in halves so that no bigint overflows."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    upper = F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * low + upper).bitwiseAND(F.lit(MASK32))


def seeded_draw(index: Column, seed: int) -> Column:
    """The ``index``-th (1-based) number in [0,1) of the 32-bit seeded sequence.

    The generator's state is the seed plus a multiple of a constant, so draw ``i`` needs no
    earlier draw and rows can be numbered in any partition.
    """
    a = (F.lit(seed) + _mul32(index.cast("long").bitwiseAND(F.lit(MASK32)), F.lit(STEP).cast("long"))).bitwiseAND(F.lit(MASK32))
    t = _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    mixed = _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
    t = ((t + mixed).bitwiseAND(F.lit(MASK32))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0


def question_ids(rows: DataFrame, source_rows: int | None = None) -> DataFrame:
    """``rows(pos, node, ...)``: the n-th repeat of a node gets ``.n``; an empty node is ``Q``."""
    named = rows.withColumn("node", F.coalesce(F.nullif("node", F.lit("")), F.lit("Q")))
    seen = running(named, ["node"], [F.col("pos")], source_rows=source_rows)
    suffix = F.when(F.col("rn") > 1, F.concat(F.lit("."), F.col("rn").cast("string"))).otherwise("")
    return seen.withColumn("id", F.concat("node", suffix)).drop("rn")


def resolve(questions: DataFrame, refs: DataFrame, available: DataFrame) -> DataFrame:
    """Whether each question is usable: it names files (``refs(query_id, file)``) and all of them exist.

    Kept long, with counts in place of lists, so a question naming very many files stays distributed.
    """
    have = available.select("file").distinct().withColumn("_in", F.lit(True))
    checked = refs.join(have, "file", "left").groupBy("query_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("_in").isNull()).alias("n_missing"),
        F.min(F.when(F.col("_in").isNull(), F.col("file"))).alias("first_missing"),
    )
    counted = questions.select("query_id").join(checked, "query_id", "left").select(
        "query_id", F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"), "first_missing",
    )
    return counted.withColumn("usable", (F.col("n_files") > 0) & (F.col("n_missing") == 0))


def distractors(docs: DataFrame, gold: DataFrame, cfg: Config = DEFAULTS, source_rows: int | None = None) -> DataFrame:
    """Documents outside ``gold(doc_id)`` but in a folder with gold, each with its seeded draw.

    Draws follow document order. The selection takes them by draw until the corpus is full.
    """
    folders = docs.join(gold.select("doc_id").distinct(), "doc_id", "left_semi").select("folder").distinct()
    pool = docs.join(gold.select("doc_id").distinct(), "doc_id", "left_anti").join(folders, "folder", "left_semi")
    numbered = running(pool.select("doc_id", "folder"), [], [F.col("doc_id")], source_rows=source_rows)
    return numbered.select("doc_id", "folder", seeded_draw(F.col("rn"), cfg.seed).alias("draw"))


def select_corpus(docs: DataFrame, gold: DataFrame, pool: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """All gold documents, then distractors by draw up to the corpus size."""
    chosen = docs.join(gold.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit("gold").alias("role"))
    room = max(cfg.corpus_docs - chosen.count(), 0)
    extra = pool.orderBy("draw", "doc_id").limit(room).select("doc_id", F.lit("distractor").alias("role"))
    return chosen.unionByName(extra)


def last_success(rows: DataFrame, key: str, line: str, failed: Column) -> DataFrame:
    """One row per id: its last success, or its first failure; ``pos`` is where the id first appeared.

    Two partial aggregates, so an id with most of the log is reduced before it is shuffled.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(key).agg(
        F.min(line).alias("pos"),
        F.max_by(row, F.when(~failed, F.col(line))).alias("ok"),
        F.min_by(row, F.col(line)).alias("first"),
    )
    return picked.select(F.coalesce("ok", "first").alias("r"), "pos").select("r.*", "pos")


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def chunk_stats(chunks: DataFrame, source_rows: int | None = None) -> DataFrame:
    """Number, total and mean size of chunks; least, upper-median and most chunks per document."""
    from rankloom.operators.metrics import lower_index_percentiles

    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum(F.length("body")).alias("chars"))
    one = per_doc.select("c", "chars", F.lit(0).alias("k"))
    totals = one.groupBy("k").agg(
        F.count("*").alias("documents"), F.sum("c").alias("chunks"), F.sum("chars").alias("chars"),
        F.round(F.sum("chars") / F.sum("c"), 9).alias("mean_chars"), F.min("c").alias("min_chunks"), F.max("c").alias("max_chunks"),
    )
    middle = lower_index_percentiles(one, ["k"], "c", source_rows).select("k", F.col("p50_index").alias("median_chunks"))
    return totals.join(middle, "k").drop("k")
