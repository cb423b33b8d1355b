"""Exact nearest vectors for many queries in one pass over the collection.

Spark partitions and streams the collection; inside a task each Arrow batch meets the query
matrix in one matrix product and only the best ``k`` per query of the whole partition leave
it. Queries travel to the tasks only while they fit ``broadcast_values``; beyond that both
sides are cut into blocks and every pair of blocks is one bounded task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.vectors import HASHED, Batches
from rankloom.operators.lexical import best_k
from rankloom.operators.postings import PIECE

PAIR_SCHEMA = "query_id long, chunk_id long, score double"
SCORE_DIGITS = 9
SIMILARITY_VALUES = 500_000
QUERY_ROWS = 2_048  # queries that meet a slice of the collection at once
BLOCK_ROWS = 10_000  # rows of a block that are made a dense matrix at once
WAITING = 65_536


ALL = 2**62  # no cut: every pair of a block is kept


def _width(vectors: DataFrame, dims: int) -> int:
    """Values that one row takes as a dense vector, so that bounds count what is really held."""
    if vectors.schema["vec"].dataType.elementType.typeName() == "struct":
        return dims
    return max(1, vectors.agg(F.max(F.size("vec"))).first()[0] or 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Dense float64 rows from a column of value lists or of sparse (dim, v) lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if not pa.types.is_struct(column.type.value_type):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    out = np.zeros((len(column), dims))
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    out[rows, flat.field("dim").to_numpy()] = flat.field("v").to_numpy()
    return out


def _similarity(q: np.ndarray, c: np.ndarray, cosine: bool) -> np.ndarray:
    sims = q @ c.T
    if cosine:
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        sims = np.divide(sims, scale, out=np.zeros_like(sims), where=scale > 0)
    return sims


class Best:
    """The ``k`` best rows of every query so far, by (score desc, id asc).

    Queries are taken ``QUERY_ROWS`` at a time, so the work arrays have a size that depends on neither side. A row is
    kept only if it reaches its query's ``k``-th best, and rows that wait are cut down as soon as they are as many as
    those that stay.
    """

    def __init__(self, q: np.ndarray, k: int, cosine: bool):
        self.q, self.k, self.cosine = q, k, cosine
        self.limit = np.full(len(q), -np.inf)
        self.kept: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(0, len(q), QUERY_ROWS)]
        self.waiting = [0] * len(self.kept)

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        for group in range(len(self.kept)):
            own = slice(group * QUERY_ROWS, (group + 1) * QUERY_ROWS)
            q = self.q[own]
            step = max(1, SIMILARITY_VALUES // len(q))
            for at in range(0, len(c), step):
                sims = _similarity(q, c[at : at + step], self.cosine)
                row, col = np.nonzero(~(sims < self.limit[own][:, None] - 10.0**-SCORE_DIGITS))
                if not len(row):
                    continue
                self.kept[group].append((row, ids[at + col], np.round(sims[row, col], SCORE_DIGITS)))
                self.waiting[group] += len(row) + PIECE
                if self.waiting[group] > max(WAITING, self.k * len(q)):
                    self._cut(group)

    def _cut(self, group: int) -> None:
        row, ids, score = (np.concatenate(x) for x in zip(*self.kept[group], strict=True))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff([*first, len(row)])
        full = first[size >= self.k]
        self.limit[group * QUERY_ROWS + row[full]] = score[full + self.k - 1]
        stays = np.arange(len(row)) - np.repeat(first, size) < self.k
        self.kept[group] = [(row[stays], ids[stays], score[stays])]
        self.waiting[group] = 0

    def pairs(self, query_ids: np.ndarray) -> Iterator[dict]:
        """The best rows as columns, some queries at a time."""
        for group in range(len(self.kept)):
            if self.kept[group]:
                self._cut(group)
                row, ids, score = self.kept[group][0]
                yield {"query_id": query_ids[group * QUERY_ROWS + row], "chunk_id": ids, "score": score}


NO_PAIRS = {"query_id": np.empty(0, np.int64), "chunk_id": np.empty(0, np.int64), "score": np.empty(0)}


def best_of_blocks(q: pa.Table, c: pa.Table, k: int, cosine: bool, dims: int) -> pa.Table:
    """The best rows of a block ``c(chunk_id, vec)`` for each query of a block ``q(query_id, vec)``."""
    parts = [NO_PAIRS]
    if q.num_rows and c.num_rows:
        best = Best(_matrix(q.column("vec"), dims), k, cosine)
        for at in range(0, c.num_rows, BLOCK_ROWS):
            some = c.slice(at, BLOCK_ROWS)
            best.add(some.column("chunk_id").to_numpy(), _matrix(some.column("vec"), dims))
        parts += best.pairs(q.column("query_id").to_numpy())
    return pa.concat_tables(pa.Table.from_pydict(x) for x in parts)


def _collect_within(queries: DataFrame, limit: int):
    """The query rows when their number is at most ``limit``, else None."""
    rows = queries.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def _one_pass(queries: pa.Table, collection: DataFrame, k: int, cosine: bool, dims: int, made: Batches = iter) -> DataFrame:
    spark = collection.sparkSession
    qids = queries.column(0).to_numpy()
    shared = spark.sparkContext.broadcast((qids, _matrix(queries.column(1), dims)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        best = Best(q, k, cosine)
        for batch in made(batches):
            best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), dims))
        for part in best.pairs(query_ids):
            yield pa.RecordBatch.from_pydict(part)

    return collection.mapInArrow(scan, PAIR_SCHEMA)


def _block_grid(queries: DataFrame, collection: DataFrame, k: int, cosine: bool, dims: int,
                q_block: int, c_block: int) -> DataFrame:
    """Every block of queries meets every block of the collection in a task of its own."""
    q_cuts = max(1, -(-queries.count() // q_block))
    c_cuts = max(1, -(-collection.count() // c_block))
    block = lambda col, cuts: F.pmod(F.xxhash64(col), F.lit(cuts)).cast("int")
    spread = lambda cuts: F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))
    left = queries.withColumn("qb", block("query_id", q_cuts)).withColumn("cb", spread(c_cuts))
    right = collection.withColumn("cb", block("chunk_id", c_cuts)).withColumn("qb", spread(q_cuts))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        return best_of_blocks(q, c, k, cosine, dims)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, PAIR_SCHEMA)


def nearest(queries: DataFrame, collection: DataFrame, k: int, cosine: bool = True, cfg: Config = DEFAULTS,
            dims: int = 64, made: Batches | None = None) -> DataFrame:
    """``queries(query_id, vec)`` against ``collection(chunk_id, vec)``: top ``k`` with rank.

    ``vec`` is an array of numbers, or of sparse (dim, v) pairs below ``dims``. With ``made``, which turns batches of
    ``collection(chunk_id, ...)`` into batches of (chunk_id, vec), one Python worker of a task makes the vectors and
    compares them; two operators one behind the other would hold two workers for each core.
    """
    queries = queries.select(F.col("query_id").cast("long"), "vec")
    collection = collection.withColumn("chunk_id", F.col("chunk_id").cast("long"))
    collection = collection.select("chunk_id", "vec") if made is None else collection
    limit = max(1, cfg.broadcast_values // _width(queries, dims))
    small = _collect_within(queries, limit)
    if small is not None:
        return best_k(_one_pass(small, collection, k, cosine, dims, made or iter), k)
    vectors = collection if made is None else collection.mapInArrow(made, f"chunk_id long, {HASHED}")
    return best_k(_block_grid(queries, vectors, k, cosine, dims, limit, limit), k)


def similarities(rows: DataFrame, anchors: DataFrame, cosine: bool = True, cfg: Config = DEFAULTS,
                 dims: int = 64) -> DataFrame:
    """``rows(id, vec)`` with ``sims``: an array of (anchor, sim) over all of ``anchors(anchor, vec)``.

    Anchors are a label set; more of them than fit one copy are compared block by block.
    """
    anchors = anchors.select(F.col("anchor").cast("long"), "vec")
    rows = rows.select(F.col("id").cast("long"), "vec")
    limit = max(1, cfg.broadcast_values // _width(anchors, dims))
    small = _collect_within(anchors, limit)
    if small is None:
        every = _block_grid(anchors.withColumnRenamed("anchor", "query_id"), rows.withColumnRenamed("id", "chunk_id"),
                            ALL, cosine, dims, limit, limit)
        pair = F.struct(F.col("query_id").alias("anchor"), F.col("score").alias("sim"))
        return every.groupBy(F.col("chunk_id").alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("sims"))
    order = np.argsort(small.column(0).to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((small.column(0).to_numpy()[order], _matrix(small.column(1), dims)[order]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a = shared.value
        step = max(1, SIMILARITY_VALUES // len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sims = np.round(_similarity(_matrix(part.column(1), dims), a, cosine), SCORE_DIGITS)
                offsets = pa.array(np.arange(0, sims.size + 1, len(names), dtype=np.int32))
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.tile(names, part.num_rows)), pa.array(sims.ravel())], names=["anchor", "sim"]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pairs)], names=["id", "sims"]
                )

    return rows.mapInArrow(scan, "id long, sims array<struct<anchor: long, sim: double>>")


def centroids(vectors: DataFrame, label: str, vec: str, digits: int = 6) -> DataFrame:
    """Mean vector per label, kept at the ``digits`` of a vector literal.

    The mean is taken per (label, position), so a label with most of the rows is pre-summed
    in every task and never gathers.
    """
    parts = vectors.select(F.col(label).alias("anchor"), F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy("anchor", "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("anchor").agg(F.transform(ordered, lambda e: e["x"]).alias("vec"))
