"""A stored inverted index over text units, and exact best-k search with block bounds.

Building reads and cuts the texts once: a scan task puts units that resemble each other (their commonest word, which tells
languages apart, then their length) side by side, makes blocks of ``BLOCK_UNITS`` and turns their tokens into one row for
each (term, block) with the units, marks and lengths as parallel arrays. Texts are not shuffled (see ``session.spread``).
A search reads the narrow header columns apart from the arrays. A word that occurs everywhere has a row in each block,
and so never gathers.

A block's header bounds the score of its units from above (highest mark, shortest unit). A search goes through the blocks
with the best scores so far and unfolds a block only for questions whose k-th best the bound reaches. The result is the
same as scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import broadcast_within, shuffle_width, stored

BLOCK_UNITS = 128
BATCH_UNITS = 2_048  # units that are grouped at once
PART_ROWS = 500_000  # (question, term) rows that travel to the tasks at once
CELLS = 500_000  # (question, term) times unit that are weighed at once
WAITING = 300_000  # scored rows a task holds before it cuts them down
PIECE = 20  # rows that take as much as the arrays around the rows of one piece of work
SCORED = "query_id long, chunk_id long, score double"
SLACK = 1e-6  # sums of the same parts in another order
POSTINGS = ("term string, block long, n long, top int, shortest int, total long, chunk_ids array<long>, marks array<int>, "
            "lens array<int>")
_NAMES = [c.split()[0] for c in POSTINGS.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

Part = Callable
"""What a posting gives, from its mark and its unit's length, as columns or as arrays. Must be positive, grow with the mark
and fall with the length."""


@dataclass(frozen=True)
class Index:
    """``postings`` has a row for each (term, block); ``blocks`` a row for each block with its units (``n``) and tokens (``total``)."""

    postings: DataFrame
    blocks: DataFrame

    def totals(self) -> tuple[int, float]:
        """Number of units and their mean length."""
        row = self.blocks.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        return row["n"] or 0, (row["total"] or 0) / (row["n"] or 1)


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _alike(code: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """An order of the units by their commonest word (in this batch), then by length."""
    lead = np.full(len(lens), -1)
    full = np.flatnonzero(lens)
    if len(full):
        common = np.bincount(code)[code] * (code.max() + 1) + code
        lead[full] = np.maximum.reduceat(common, np.concatenate([[0], np.cumsum(lens[full])[:-1]]))
    return np.lexsort((lens, lead))


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(chunk_id, tokens, marks) rows to index rows of blocks of ``size`` units. Without marks every token counts 1."""
    number = TaskContext.get().partitionId() << 32
    for batch in (whole.slice(at, BATCH_UNITS) for whole in batches for at in range(0, whole.num_rows, BATCH_UNITS)):
        units = batch.num_rows
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lens = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = batch.column(1).flatten().dictionary_encode()
        names, code = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = _alike(code, lens)
        place_of = np.empty_like(order)
        place_of[order] = np.arange(units)
        unit = np.repeat(place_of, lens)
        ids, lens = ids[order], lens[order]
        starts = np.arange(0, units, size)
        n, none = len(starts), pa.nulls(len(starts))
        yield _rows([none, number + np.arange(n), np.diff([*starts, units]), none, none, np.add.reduceat(lens, starts), none, none, none])
        if len(code):
            place = (unit // size * len(names) + code) * size + unit % size
            if batch.num_columns > 2:
                found, at = np.unique(place, return_inverse=True)
                mark = np.bincount(at, batch.column(2).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            else:
                found, mark = np.unique(place, return_counts=True)
            row = found // size
            of = row // len(names) * size + found % size
            cuts = np.flatnonzero(np.diff(row, prepend=-1))
            offsets = pa.array([*cuts, len(found)], pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids[of], pa.int64()), (mark, pa.int32()), (lens[of], pa.int32()))]
            yield _rows([names.take(pa.array(row[cuts] % len(names))), number + row[cuts] // len(names), np.diff([*cuts, len(found)]),
                         np.maximum.reduceat(mark, cuts), np.minimum.reduceat(lens[of], cuts), pa.nulls(len(cuts)), *listed])
        number += n


def build(units: DataFrame, tokens: Column, marks: Column | None = None, block_units: int | None = None) -> Index:
    """Index of ``units(chunk_id, ...)`` over an array of tokens and, if given, an array of whole marks beside it."""
    size = block_units or BLOCK_UNITS
    columns = [F.col("chunk_id").cast("long"), tokens.alias("tokens"), *([] if marks is None else [marks.alias("marks")])]
    table = stored(units.select(*columns).mapInArrow(lambda batches: _grouped(batches, size), POSTINGS))
    return Index(table.where(F.col("term").isNotNull()).drop("total"), table.where(F.col("term").isNull()).select("block", "n", "total"))


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df) of the given terms: how many units hold each. Reads the header columns only."""
    wanted = terms.select("term").distinct()
    return index.postings.select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))


def lengths(index: Index, terms: DataFrame) -> DataFrame:
    """(term, len_sum): the lengths of the units that hold each of the given terms, summed."""
    wanted = terms.select("term").distinct()
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.postings.select("term", total.alias("total")).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("total").alias("len_sum"))


def matches(index: Index, weights: DataFrame) -> DataFrame:
    """``weights(query_id, term, ...)`` beside ``p``, the posting (chunk_ids, marks, lens) of one unit that holds the term."""
    return index.postings.select("term", "chunk_ids", "marks", "lens").join(weights, "term").drop("term").select(
        *[c for c in weights.columns if c != "term"], F.explode(F.arrays_zip("chunk_ids", "marks", "lens")).alias("p"))


def score(index: Index, weights: DataFrame, part: Part, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every unit with a term of ``weights(query_id, term, weight)``, unrounded.

    ``pairs(query_id, block)`` limits it to these blocks, whose postings alone are unfolded.
    """
    rows = index.postings.select("term", "block", "chunk_ids", "marks", "lens").join(weights, "term")
    if pairs is not None:
        rows = rows.join(pairs, ["query_id", "block"], "left_semi")
    each = rows.select("query_id", "weight", F.explode(F.arrays_zip("chunk_ids", "marks", "lens")).alias("p"))
    gives = F.col("weight") * part(F.col("p.marks"), F.col("p.lens"))
    return each.groupBy("query_id", F.col("p.chunk_ids").alias("chunk_id")).agg(F.sum(gives).alias("score"))


@dataclass(frozen=True)
class _Asked:
    """(question, term, weight) rows as arrays, sorted by question; ``start`` is where each question begins."""

    queries: np.ndarray
    start: np.ndarray
    terms: pa.Array
    term: np.ndarray
    weight: np.ndarray

    @cached_property
    def question(self) -> np.ndarray:
        """The place of each row's question."""
        return np.repeat(np.arange(len(self.start)), np.diff(self.start, append=len(self.term)))


def _asked(rows: pa.Table) -> _Asked:
    rows = rows.sort_by("query_id")
    ids = rows.column("query_id").to_numpy()
    start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    coded = rows.column("term").combine_chunks().dictionary_encode()
    return _Asked(ids[start], start, coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows.column("weight").to_numpy().astype(np.float64))


class _Best:
    """The ``k`` best units of every question so far, and the score a unit must reach to become one."""

    def __init__(self, asked: _Asked, part: Part, k: int, waiting: int = WAITING):
        self.asked, self.part, self.k, self.most = asked, part, k, waiting
        self.limit = np.full(len(asked.queries), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def block(self, term: np.ndarray, top: np.ndarray, shortest: np.ndarray, ids: np.ndarray, marks: np.ndarray, lens: np.ndarray, sizes: np.ndarray) -> None:
        """The postings of one block: a header for each term and ``sizes`` entries of each, one after the other."""
        a = self.asked
        place = np.full(len(a.terms), -1)
        place[term] = np.arange(len(term))
        held = np.flatnonzero(place[a.term] >= 0)
        question = a.question[held]
        at = place[a.term[held]]
        bound = np.bincount(question, a.weight[held] * self.part(top, shortest)[at], len(a.queries))
        open_ = (np.bincount(question, minlength=len(a.queries)) > 0) & (bound >= self.limit - SLACK)
        stays = open_[question]
        if not stays.any():
            return
        held, question, at = held[stays], question[stays], at[stays]
        units, column = np.unique(ids, return_inverse=True)
        gives = np.zeros((len(term), len(units)))
        gives[np.repeat(np.arange(len(term)), sizes), column] = self.part(marks, lens)
        first = np.flatnonzero(np.diff(question, prepend=-1))
        ends, room, x = np.append(first[1:], len(held)), max(1, CELLS // len(units)), 0
        while x < len(first):  # questions whose rows make one array of bounded size
            y = max(x + 1, int(np.searchsorted(ends, first[x] + room, side="right")))
            part = slice(first[x], ends[y - 1])
            scores = np.add.reduceat(a.weight[held[part]][:, None] * gives[at[part]], first[x:y] - first[x], axis=0)
            row, unit = np.nonzero((scores > 0) & (scores >= self.limit[question[first[x:y]]][:, None] - SLACK))
            x, found = y, (question[first[x + row]], units[unit], scores[row, unit])
            if len(row):
                self.kept.append(found)
                self.waiting += len(row) + PIECE
            if self.waiting > self.most:
                self.cut()

    def cut(self) -> None:
        """Keep the best and raise the limits. Rows within rounding of the limit stay; of rows with one and the same score
        the ``k`` smallest ids, so ties at the limit do not grow with the collection."""
        if not self.kept:
            return
        question, unit, score = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((unit, -score, question))
        question, unit, score = question[order], unit[order], score[order]
        first = np.flatnonzero(np.diff(question, prepend=-1))
        size = np.diff([*first, len(question)])
        full = size >= self.k
        self.limit[question[first[full]]] = score[first[full] + self.k - 1]
        tie = np.flatnonzero((np.diff(question, prepend=-1) != 0) | (np.diff(score, prepend=-1.0) != 0))
        place = np.arange(len(question)) - np.repeat(tie, np.diff([*tie, len(question)]))
        stays = (score >= self.limit[question] - SLACK) & (place < self.k)
        self.kept = [(question[stays], unit[stays], score[stays])]
        self.waiting = 0


def _searching(asked: _Asked, part: Part, k: int, waiting: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks in order to the best units of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rest = _Best(asked, part, k, waiting), None
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)

        def take(table: pa.Table) -> None:
            block = table.column("block").to_numpy()
            cuts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]
            term = pc.index_in(table.column("term"), asked.terms).to_numpy()
            sizes, top, shortest = (table.column(c).to_numpy() for c in ("n", "top", "shortest"))
            ids, marks, lens = (flat(table, c) for c in ("chunk_ids", "marks", "lens"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                own = slice(ends[x], ends[y])
                best.block(term[x:y], top[x:y], shortest[x:y], ids[own], marks[own], lens[own], sizes[x:y])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            block = table.column("block").to_numpy()
            whole = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
            if whole:
                take(table.slice(0, whole).combine_chunks())
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            take(rest.combine_chunks())
        best.cut()
        for question, unit, score in best.kept:
            yield pa.RecordBatch.from_arrays([pa.array(asked.queries[question]), pa.array(unit), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return run


def best(index: Index, weights: DataFrame, part: Part, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of a set of units that holds the ``k`` best of each question.

    Postings of the asked terms meet by block, once for all questions. A task goes through its blocks in order and keeps the
    best units so far; a block whose bound stays below a question's k-th best is not unfolded for it. Questions go
    to the tasks in parts of ``PART_ROWS`` rows of ``weights(query_id, term, weight)``, whose weights are above 0.
    """
    spark = weights.sparkSession
    weights = weights.select(F.col("query_id").cast("long"), "term", F.col("weight").cast("double"))
    rows = weights.limit(PART_ROWS + 1).toArrow()
    if rows.num_rows <= PART_ROWS:
        return _part(index, rows, part, k)
    weights = stored(weights)
    parts = -(-weights.count() // PART_ROWS) + 1
    cut = (weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow() for i in range(parts))
    return reduce(DataFrame.unionByName, [_part(index, rows, part, k) for rows in cut], spark.createDataFrame([], SCORED))


def _part(index: Index, rows: pa.Table, part: Part, k: int) -> DataFrame:
    """The search for the questions of at most about ``PART_ROWS`` rows, whose terms are broadcast."""
    spark = index.postings.sparkSession
    if not rows.num_rows:
        return spark.createDataFrame([], SCORED)
    asked = _asked(rows)
    terms = broadcast_within(spark.createDataFrame(pa.table({"term": asked.terms.cast(pa.string())})), len(asked.terms))
    held = index.postings.join(terms, "term", "left_semi").repartition(shuffle_width(spark), "block").sortWithinPartitions("block")
    return held.mapInArrow(_searching(asked, part, k, WAITING), SCORED)
