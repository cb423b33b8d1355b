"""The cell index: true neighbours, blocks of hot cells, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.operators import cells, dense


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(5)
    centres = g.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12 if i % 3 else 0] + 0.4 * g.normal(size=16)]) for i in range(1500)]
    return spark.createDataFrame(rows, "chunk_id long, vec array<double>")


def test_recall_against_exact_search(clustered):
    queries = clustered.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = cells.fit(clustered, 10)
    assert 1 <= index.probes < len(index.centres)
    found, exact = cells.search(queries, clustered, index, 10), dense.nearest(queries, clustered, 10)
    row = cells.recall(exact, found).first()
    assert (row.n_queries, row.n_wanted) == (30, 300) and row.recall >= 0.9
    same = found.join(exact.select("query_id", "chunk_id", F.col("score").alias("s")), ["query_id", "chunk_id"])
    assert same.where("abs(score - s) > 1e-9").count() == 0


def test_blocks_of_a_hot_cell_change_nothing(clustered):
    """A third of the rows lie in one cell; cutting cells into blocks of a few rows gives the same result."""
    queries = clustered.where("chunk_id % 75 = 0").withColumnRenamed("chunk_id", "query_id")
    index = cells.fit(clustered, 5)
    whole, cut = (cells.search(queries, clustered, index, 5, cfg=Config(broadcast_values=v)) for v in (4_000_000, 16 * 40))
    assert sorted(whole.collect()) == sorted(cut.collect())
    every = cells.search(queries, clustered, cells.Cells(index.centres, len(index.centres)), 5)
    assert sorted(every.collect()) == sorted(dense.nearest(queries, clustered, 5).collect())


def test_odd_collections(spark, clustered):
    queries = clustered.limit(3).withColumnRenamed("chunk_id", "query_id")
    none = clustered.where("false")
    assert cells.search(queries, none, cells.fit(none, 5), 5).count() == 0
    assert cells.search(queries.where("false"), clustered, cells.fit(clustered, 5), 5).count() == 0
    same = clustered.limit(60).withColumn("vec", F.array(*[F.lit(1.0)] * 16)).unionByName(clustered.limit(2).withColumn("vec", F.array(*[F.lit(0.0)] * 16)))
    assert cells.search(queries, same, cells.fit(same, 5), 5).count() == 15
