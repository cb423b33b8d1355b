"""Classifiers fitted with Spark ML: TF-IDF and vector logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rankloom.session import broadcast_within, shuffle_width, stored


def word_ngrams(text: Column) -> Column:
    """Words of two or more characters and their neighbouring pairs."""
    w = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), lambda t: F.length(t) > 1)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character runs inside space-padded words; a word shorter than a run counts once as it is."""
    padded = F.transform(
        F.filter(F.split(F.lower(text), "\\s+"), lambda t: F.length(t) > 0), lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    )

    def runs(w, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

    def of_word(w):
        fits = [F.when((F.length(w) >= n) | (F.length(w) == n - 1), runs(w, n)).otherwise(F.array().cast("array<string>"))
                for n in range(low, high + 1)]
        return F.concat(*fits)

    return F.flatten(F.transform(padded, of_word))


BLOCKS = {"w": (word_ngrams, 30_000, 1), "c": (char_ngrams, 60_000, 2)}
SLICE_CHARS = 1 << 19  # text whose tokens a task counts at once


def _tokens(messages: DataFrame, *blocks: str) -> DataFrame:
    """(id, block, term): a row for each token of the named blocks, default all.

    Messages travel by ``id`` as they are; their many more tokens are counted where they arise. They go to so many tasks
    that the counts and vectors a task holds, and the files it writes, do not grow with the table.
    """
    def tagged(block):
        return F.transform(BLOCKS[block][0](F.col("text")), lambda t: F.struct(F.lit(block).alias("block"), t.alias("term")))

    chars = messages.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = messages.select("id", "text").repartition(max(shuffle_width(messages.sparkSession), -(-chars // SLICE_CHARS)), "id")
    return dealt.select("id", F.explode(F.concat(*map(tagged, blocks or BLOCKS))).alias("t")).select("id", "t.block", "t.term")


def _term_counts(messages: DataFrame, *blocks: str) -> DataFrame:
    """(id, block, term, tf): the tokens of the named blocks, default all, counted per message."""
    return _tokens(messages, *blocks).groupBy("id", "block", "term").agg(F.count("*").alias("tf"))


def vocabulary(messages: DataFrame, n_messages: int) -> DataFrame:
    """(block, term, i, idf): the most used terms of each block, a bounded number, with smoothed idf."""
    out, base = None, 0
    for block, (_, size, min_df) in BLOCKS.items():
        stats = _term_counts(messages, block).groupBy("block", "term").agg(F.sum("tf").alias("uses"), F.count("*").alias("df"))
        kept = stats.where(F.col("df") >= min_df).orderBy(F.col("uses").desc(), "term").limit(size)
        order = Window.partitionBy("block").orderBy(F.col("uses").desc(), "term")
        part = kept.select("block", "term", (F.row_number().over(order) - 1 + base).alias("i"),
                           (F.log((1.0 + n_messages) / (1.0 + F.col("df"))) + 1).alias("idf"))
        out, base = part if out is None else out.unionByName(part), base + size
    return out


def sparse_vectors(rows: DataFrame, size: int) -> DataFrame:
    """``pairs``, an array of (i, x) in the order of ``i``, as the sparse vector ``features``.

    The parts of a vector are written as they are and read back as one, so no row passes through Python.
    """
    plain = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     F.col("pairs.i").alias("indices"), F.col("pairs.x").alias("values"))
    kept = [c for c in rows.columns if c != "pairs"]
    schema = StructType([*[rows.schema[c] for c in kept], StructField("features", VectorUDT())])
    return stored(rows.select(*kept, plain.alias("features")), schema)


def tfidf_features(train: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """``(id, text, label)`` frames with ``features``: damped counts times smoothed idf, each block of unit length.

    The vocabulary is learned on ``train``; it has at most as many rows as the blocks allow, so it is
    broadcast, and only its terms are counted. Counting, weighting and scaling are aggregations by message.
    """
    size = sum(limit for _, limit, _ in BLOCKS.values())
    known = broadcast_within(stored(vocabulary(train, train.count())), size)
    none = F.array().cast("array<struct<i:int,x:double>>")

    def features(frame: DataFrame) -> DataFrame:
        used = _tokens(frame).join(known, ["block", "term"]).groupBy("id", "block", "i", "idf").agg(F.count("*").alias("tf"))
        weighted = used.select("id", "block", "i", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
        blocks = weighted.groupBy("id", "block").agg(
            F.collect_list(F.struct("i", "x")).alias("pairs"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")
        )
        scaled = F.transform("pairs", lambda p: F.struct(p["i"].alias("i"), (p["x"] / F.col("norm")).alias("x")))
        rows = blocks.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(scaled))).alias("pairs"))
        both = frame.select("id", "label").join(rows, "id", "left")
        return sparse_vectors(both.select("id", "label", F.coalesce("pairs", none).alias("pairs")), size)

    return [features(f) for f in (train, *frames)]


def vector_features(frame: DataFrame) -> DataFrame:
    return frame.select("id", "label", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))


def fit_predict(train: DataFrame, test: DataFrame, c: float, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """Multinomial logistic regression with inverse penalty ``c`` per row; class probabilities of ``test``.

    Rows are ``(id, label, features)``.
    """
    test = test.withColumn("label", F.col("label").cast("string"))
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    model = LogisticRegression(
        labelCol="_y", featuresCol="features", family="multinomial", standardization=False,
        regParam=1.0 / (c * max(train.count(), 1)), maxIter=iterations, tol=tol,
    ).fit(index.transform(train))
    names = F.array(*[F.lit(n) for n in index.labels])
    scored = model.transform(test).select("id", F.col("label").alias("gold"), vector_to_array("probability").alias("p"))
    pairs = F.zip_with(names, F.col("p"), lambda l, p: F.struct(l.alias("label"), F.round(p, 9).alias("p")))
    return scored.select("id", "gold", pairs.alias("pairs"))
