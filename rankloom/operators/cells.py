"""Approximate nearest vectors: a coarse index of cells, exact scores inside the nearest cells.

Cells are the k-means centres of a bounded sample (``SAMPLE_ROWS``); every row is put into the cell of its nearest centre.
A query looks into its ``probes`` nearest cells. How many are needed is measured when the index is fitted, as the
smallest number that finds the target share of the true neighbours among the sample. Rows and queries of a cell meet in blocks
of bounded size, so a cell with most of the rows spreads over many tasks, and only the best ``k`` of a block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.operators.dense import PAIR_SCHEMA, _matrix, best_of_blocks
from rankloom.operators.lexical import best_k

SAMPLE_ROWS, MAX_CELLS, CHECK_QUERIES, TARGET = 20_000, 1_024, 256, 0.97
_HASHES = 1 << 30


@dataclass(frozen=True)
class Cells:
    """Unit centres, one row for each cell, and the number of cells a query looks into."""

    centres: np.ndarray
    probes: int


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _nearest_cells(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first; ties by number."""
    return np.argsort(-np.round(_units(rows) @ centres.T, 9), axis=1, kind="stable")[:, :n]


def _needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The smallest number of cells that holds the target share of the neighbours of the first rows of the sample."""
    asked = sample[:CHECK_QUERIES]
    near = np.argsort(-(_units(asked) @ _units(sample).T), axis=1, kind="stable")[:, :k]
    order = _nearest_cells(asked, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    home = _nearest_cells(sample, centres, 1)[:, 0]
    reached = np.take_along_axis(place, home[near], axis=1)  # how many cells each neighbour takes, less one
    share = (reached[:, :, None] <= np.arange(len(centres))).mean(axis=(0, 1))
    return int(np.argmax(share >= target)) + 1


def fit(collection: DataFrame, k: int, target: float = TARGET) -> Cells:
    """Cells of ``collection(chunk_id, vec)`` by cosine, from a sample by id hash."""
    n = collection.count()
    if not n:
        return Cells(np.zeros((0, 1)), 0)
    share = min(_HASHES, -(-_HASHES * SAMPLE_ROWS // n))
    drawn = collection.where(F.pmod(F.xxhash64("chunk_id"), F.lit(_HASHES)) < share).limit(2 * SAMPLE_ROWS)
    unit = drawn.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"), "vec")
    sample = _matrix(unit.select("vec").toArrow().column(0), 0)
    sample = sample[np.argsort(sample.sum(axis=1), kind="stable")][np.random.default_rng(7).permutation(len(sample))]
    cells = max(1, min(MAX_CELLS, round(len(sample) ** 0.5), len(np.unique(_units(sample).round(6), axis=0))))
    nonzero = unit.where(F.exists("vec", lambda x: x != 0))
    if cells == 1:
        return Cells(np.zeros((1, sample.shape[1])), 1)
    model = KMeans(k=cells, seed=7, maxIter=10, distanceMeasure="cosine").fit(nonzero)
    centres = _units(np.array(model.clusterCenters()))
    return Cells(centres, _needed(sample, centres, k, target))


def placed(rows: DataFrame, cells: Cells, n: int) -> DataFrame:
    """``rows(id, vec)`` once for each of its ``n`` nearest cells, with ``cell``."""
    shared = rows.sparkSession.sparkContext.broadcast(cells.centres)
    name, kind = rows.columns[0], rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest_cells(_matrix(batch.column(1), 0), shared.value, n)
                again = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in batch.columns], pa.array(near.ravel())], names=[name, "vec", "cell"])

    return rows.mapInArrow(run, f"{name} long, vec {kind}, cell long")


def search(queries: DataFrame, collection: DataFrame, cells: Cells, k: int, cosine: bool = True, cfg: Config = DEFAULTS) -> DataFrame:
    """``queries(query_id, vec)`` against ``collection(chunk_id, vec)``: the best ``k`` in the probed cells, with rank."""
    if not len(cells.centres):
        return best_k(queries.sparkSession.createDataFrame([], PAIR_SCHEMA), k)
    rows = placed(collection.select(F.col("chunk_id").cast("long"), "vec"), cells, 1)
    asked = placed(queries.select(F.col("query_id").cast("long"), "vec"), cells, cells.probes)
    block = max(1, cfg.broadcast_values // cells.centres.shape[1])
    cuts = lambda name: F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name)
    # At most a row for each cell.
    sizes = F.broadcast(rows.groupBy("cell").agg(cuts("_c")).join(asked.groupBy("cell").agg(cuts("_q")), "cell"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").withColumn("q", own("query_id", "_q")).withColumn("c", every("_c")).drop("_c", "_q")
    right = rows.join(sizes, "cell").withColumn("c", own("chunk_id", "_c")).withColumn("q", every("_q")).drop("_c", "_q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_of_blocks(a, b, k, cosine, 0)

    key = ["cell", "q", "c"]
    return best_k(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, PAIR_SCHEMA), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_queries, n_wanted (true neighbours) and the share of these that was found."""
    pairs = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return pairs.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
