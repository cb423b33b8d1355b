"""Ranked lexical search over bit-sliced Bloom signatures.

Index: one scan cuts the documents into blocks of similar term counts. A block is a matrix of bits with a column for
each document; a term of a document sets ``PROBES`` rows in its column, and sets further rows for every level of
``LEVELS`` that its count reaches. The matrix is stored row by row (bit slices), with the block's terms and document
frequencies and with the texts.

Search: the slices of a term, combined by AND, are a bitmap of documents that holds every document with the term (and
some more), one for each level. A level bounds the count, so weights times the largest contribution at that level, summed
over an item's terms, bound the score from above. The documents with the highest bounds are scored exactly; their
``k``-th best score is a limit that the ``k`` best must reach, and every document whose bound reaches it is scored
exactly. Only documents proven to stay below the limit are left out, so the result is that of scoring all.

Items are searched in blocks of bounded size against all blocks of documents, and the result of each block of items
is written before the next is asked. Nothing but the terms of one block of items, their document frequencies and one
limit for each item passes through the driver.

Score, in whole numbers: see ``contribution``; w = floor(1000 ln((2N + 2) / (2 df + 1))). N counts documents with a
term. Document frequencies are counted over 64-bit term hashes, exact scores over the terms themselves.

Defined results: null and empty texts have no term, are not counted and never ranked; a document without doc_id counts in
the statistics but cannot be named, so it is not ranked; repeated rows are ranked each; rows of ``benchmark`` that
share an item_id (null included) are one item with the terms of all; an item without terms or without a matching
document has no row; equal scores rank by ascending doc_id; extra columns are ignored; empty tables give no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays
from rankloom.llm.tables import slices, written

U64 = np.uint64
TOP = 50
LEVELS = (1, 2, 4, 8, 16)
PROBES, BITS_PER_KEY = 6, 16
BLOCK_DOCS, BLOCK_CELLS, MAX_ROWS = 512, 1 << 23, 1 << 20
BLOCK_PAIRS = 16_000  # (item, term) rows that are asked at once
CELLS = 1 << 21  # values of the largest work array
GAP = np.ones(256, bool)
GAP[np.r_[48:58, 65:91, 97:123, 128:256]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAPS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BLOCK_SCHEMA = ("block long, n_docs long, n_words long, doc_ids array<long>, sizes array<long>, texts array<string>, "
                "n_rows int, slices binary, terms binary, counts binary")
PART_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.large_string()),
              pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def terms_of(text: Column) -> Column:
    """The terms of a text in order, as an array; null for null."""
    return F.filter(F.split(F.translate(text, CAPITALS, CAPITALS.lower()), GAPS), lambda t: t != "")


def contribution(tf, m):
    """Share of one term that occurs ``tf`` times in a document of measure ``m``; grows with ``tf``. Works on arrays."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def measure(n, documents: int, words: int):
    """100 - 50 + 50 times the document's length over the mean length, rounded down."""
    return 50 + (50 * n * documents) // words


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _probes(keys: np.ndarray, rows: int) -> np.ndarray:
    """Rows of each key (one more axis); ``rows`` is a power of two."""
    low, step = keys & U64(0xFFFFFFFF), (keys >> U64(32)) | U64(1)
    with np.errstate(over="ignore"):
        return ((low[..., None] + step[..., None] * np.arange(PROBES, dtype=U64)) & U64(rows - 1)).astype(np.int64)


def _at_level(terms: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrays.scramble(terms + U64(level) * U64(0x9E3779B97F4A7C15))


# ------------------------------------------------------------------------------------------------------------ index


@dataclass
class _Doc:
    doc_id: int | None
    text: str
    size: int
    terms: np.ndarray
    tf: np.ndarray
    n_keys: int


def _documents(part: pa.RecordBatch) -> Iterator[_Doc]:
    body, starts = arrays.raw(part.column(1))
    body = LOWER[body]
    begin, end = arrays.spans(body, starts, GAP)
    hashed, bounds = arrays.hashes(body, begin, end), np.searchsorted(begin, starts)
    ids, texts = part.column(0).to_pylist(), part.column(1)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            terms, tf = np.unique(hashed[a:b], return_counts=True)
            yield _Doc(ids[i], texts[i].as_py(), int(b - a), terms, tf, int(sum(np.count_nonzero(tf >= n) for n in LEVELS)))


def _rows_for(n_keys: int) -> int:
    """Rows of the matrix of a document with so many keys, a power of two. Beyond MAX_ROWS bounds only get looser."""
    return min(MAX_ROWS, 1 << max(6, (BITS_PER_KEY * n_keys - 1).bit_length()))


def _capacity(rows: int) -> int:
    return max(8, min(BLOCK_DOCS, BLOCK_CELLS // rows))


def _packed(number: int, rows: int, docs: list[_Doc]) -> dict:
    """One block. Documents without id only count in the statistics."""
    named = [d for d in docs if d.doc_id is not None]
    bits = np.zeros((rows, -(-max(1, len(named)) // 8) * 8), np.uint8)
    for level in LEVELS:
        held = [d.terms[d.tf >= level] for d in named]
        if held:
            column = np.repeat(np.arange(len(held)), [len(x) for x in held])
            bits[_probes(_at_level(np.concatenate(held), level), rows), column[:, None]] = 1
    terms, counts = np.unique(np.concatenate([d.terms for d in docs]), return_counts=True)
    return dict(zip(PART_NAMES, [
        number, len(docs), sum(d.size for d in docs), [d.doc_id for d in named], [d.size for d in named], [d.text for d in named],
        rows, np.packbits(bits, axis=1).tobytes(), terms.astype("<u8").tobytes(), counts.astype("<u4").tobytes()], strict=True))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with their signatures; lazily, see ``BLOCK_SCHEMA``."""
    schema = pa.schema(list(zip(PART_NAMES, PART_TYPES, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[int, list[_Doc]] = {}

        def closed(rows: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([_packed(number, rows, open_blocks.pop(rows))], schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc in _documents(part):
                    rows = _rows_for(doc.n_keys)
                    open_blocks.setdefault(rows, []).append(doc)
                    if len(open_blocks[rows]) >= _capacity(rows):
                        yield closed(rows)
        for rows in sorted(open_blocks):
            yield closed(rows)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


# ----------------------------------------------------------------------------------------------------------- search


@dataclass(frozen=True)
class Asked:
    """A block of items: ``pair_term`` lists the terms of each item from its ``item_start`` on."""

    items: list
    terms: list[bytes]
    hashes: np.ndarray
    item_start: np.ndarray
    pair_term: np.ndarray
    documents: int
    words: int
    weights: np.ndarray
    limits: np.ndarray


def _asked(pairs: pa.Table, documents: int, words: int) -> Asked:
    """From (item_id, term) rows sorted by item."""
    items, starts = [], []
    for i, item in enumerate(pairs.column("item_id").to_pylist()):
        if not items or item != items[-1]:
            items.append(item)
            starts.append(i)
    held = [t.encode() for t in pairs.column("term").to_pylist()]
    terms = sorted(set(held))
    place = {t: i for i, t in enumerate(terms)}
    body, at = arrays.raw(pa.array([t.decode() for t in terms], pa.large_string()))
    none = np.zeros(len(terms), np.int64)
    return Asked(items, terms, arrays.hashes(body, at[:-1], at[1:]), np.array([*starts, len(held)]),
                 np.array([place[t] for t in held], np.int64), documents, words, none, np.ones(len(items), np.int64))


def _frequencies(blocks: DataFrame, asked: Asked) -> np.ndarray:
    """Document frequency of each asked term: summed over the terms that the blocks list."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = np.frombuffer(terms, "<u8")
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                total += np.where(known[at] == wanted, np.frombuffer(counts, "<u4")[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    rows = blocks.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(asked.terms), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    shared.unpersist()
    return out


def _bounds(asked: Asked, sizes: np.ndarray, rows: int, packed: bytes) -> np.ndarray:
    """Upper bound of the score of every item (row) in every document (column) of a block."""
    bits = np.frombuffer(packed, np.uint8).reshape(rows, -1)
    m = measure(sizes, asked.documents, asked.words)
    # The most that a term can give at each level: below the next level's count, and at most the document's length.
    most = [np.minimum(sizes, n - 1) for n in LEVELS[1:]] + [sizes]
    gives = np.stack([np.zeros_like(m), *[contribution(tf, m) for tf in most]])
    levels = np.zeros((len(asked.terms), bits.shape[1] * 8), np.uint8)
    step = max(1, CELLS // (bits.shape[1] * PROBES))
    for a in range(0, len(asked.terms), step):
        alive = None
        for level in LEVELS:  # a count that reaches a level has reached all lower ones
            found = np.bitwise_and.reduce(bits[_probes(_at_level(asked.hashes[a:a + step], level), rows)], axis=1)
            alive = found if alive is None else alive & found
            if not alive.any():
                break
            levels[a:a + step] += np.unpackbits(alive, axis=1)
    out = np.zeros((len(asked.items), len(sizes)), np.int64)
    step = max(1, CELLS // len(asked.pair_term))
    for a in range(0, len(sizes), step):
        part = np.arange(a, min(a + step, len(sizes)))
        share = gives[levels[:, part], part] * asked.weights[:, None]
        out[:, part] = np.add.reduceat(share[asked.pair_term], asked.item_start[:-1], axis=0)
    return out


class _Exact:
    """Scores documents for given items, over the terms themselves."""

    def __init__(self, asked: Asked):
        ends = asked.item_start.tolist()
        pairs, self.asked = asked.pair_term.tolist(), asked
        self.of_item = [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.place = dict(zip(asked.terms, range(len(asked.terms)), strict=True))
        self.weights = asked.weights.tolist()

    def scores(self, text: str, size: int, items: list[int]) -> list[int]:
        place, weights = self.place, self.weights
        found = Counter(TERM.findall(text.encode().translate(LOWER.tobytes())))
        m = measure(size, self.asked.documents, self.asked.words)
        own = {place[t]: weights[place[t]] * contribution(n, m) for t, n in found.items() if t in place}
        return [sum([own[t] for t in self.of_item[i] if t in own]) for i in items]


def _candidates(blocks: DataFrame, shared, k: int) -> DataFrame:
    """(item, block, row): the documents with the highest bounds, at least the ``k`` highest of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, block, row = (np.zeros((len(asked.items), 0), np.int64) for _ in range(3))
        for batch in batches:
            for number, sizes, rows, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not sizes:
                    continue
                bound = _bounds(asked, np.array(sizes), rows, packed)
                best = np.hstack([best, bound])
                block = np.hstack([block, np.full_like(bound, number)])
                row = np.hstack([row, np.broadcast_to(np.arange(len(sizes)), bound.shape)])
                if best.shape[1] > k:
                    keep = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, block, row = (np.take_along_axis(x, keep, axis=1) for x in (best, block, row))
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(block[item, at]), pa.array(row[item, at]), pa.array(best[item, at])],
                                         names=["item", "block", "row", "bound"])

    found = blocks.select("block", "sizes", "n_rows", "slices").mapInArrow(run, "item long, block long, row long, bound long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block", "row")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r", "bound")


def _limits(blocks: DataFrame, asked: Asked, shared, k: int) -> np.ndarray:
    """For each item the ``k``-th best exact score among the documents with the highest bounds; 1 if there are fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = _Exact(shared.value)
        for batch in batches:
            items, scores = [], []
            sizes_at, texts_at, pairs_at = (batch.column(batch.schema.get_field_index(c)) for c in ("sizes", "texts", "pairs"))
            for sizes, texts, pairs in zip(sizes_at, texts_at, pairs_at.to_pylist(), strict=True):
                wanted: dict[int, list[int]] = {}
                for p in pairs:
                    wanted.setdefault(p["row"], []).append(p["item"])
                for row, some in wanted.items():
                    items += some
                    scores += exact.scores(texts[row].as_py(), sizes[row].as_py(), some)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64())], names=["item", "score"])

    # At most k rows for each item of the block, so the broadcast has a fixed bound.
    chosen = _candidates(blocks, shared, k).groupBy("block").agg(F.collect_list(F.struct("item", "row")).alias("pairs"))
    scored = blocks.join(F.broadcast(chosen), "block").select("sizes", "texts", "pairs").mapInArrow(run, "item long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc())
    last = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).toArrow()
    out = np.ones(len(asked.items), np.int64)
    out[last.column("item").to_numpy()] = np.maximum(1, last.column("score").to_numpy())
    return out


def _best(items: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each item."""
    order = np.lexsort((ids, -scores, items))
    starts = np.flatnonzero(np.diff(items[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[rank < k]


def _rescored(blocks: DataFrame, shared, k: int) -> DataFrame:
    """(item_id, doc_id, score): every document not provably below its item's limit, the ``k`` best of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        exact = _Exact(asked)
        none = np.zeros(0, np.int64)
        best = (none, none, none)
        for batch in batches:
            texts_at = batch.schema.get_field_index("texts")
            for i, (ids, sizes, rows, packed) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "n_rows", "slices")], strict=True)):
                if not sizes:
                    continue
                open_cells = _bounds(asked, np.array(sizes), rows, packed) >= asked.limits[:, None]
                texts, found = batch.column(texts_at)[i].values, []
                for row in np.flatnonzero(open_cells.any(axis=0)).tolist():
                    some = np.flatnonzero(open_cells[:, row])
                    scores = np.array(exact.scores(texts[row].as_py(), sizes[row], some.tolist()))
                    hit = scores >= asked.limits[some]
                    found.append((some[hit], scores[hit], np.full(int(hit.sum()), ids[row])))
                if found:
                    best = tuple(np.concatenate([b, *x]) for b, x in zip(best, zip(*found), strict=True))
                    keep = _best(*best, k)
                    best = tuple(b[keep] for b in best)
        names = pa.array([asked.items[i] for i in best[0].tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([names, pa.array(best[2]), pa.array(best[1])], names=["item_id", "doc_id", "score"])

    return blocks.select("doc_ids", "sizes", "n_rows", "slices", "texts").mapInArrow(run, "item_id long, doc_id long, score long")


def search(blocks: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item, from a written index: item_id, rank, doc_id, score."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_docs").alias("documents"), F.sum("n_words").alias("words")).first()
    pairs = written(items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(terms_of(F.col(text))).alias("term")).distinct())
    cuts = -(-pairs.count() // BLOCK_PAIRS) if total["documents"] else 0
    results = [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    for cut in range(cuts):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(cuts)) == cut).sort("item_id", "term").toArrow()
        if not mine.num_rows:
            continue
        asked = _asked(mine, total["documents"], total["words"])
        found = _frequencies(blocks, asked)
        asked = replace(asked, weights=np.array([weight(int(df), asked.documents) for df in found], np.int64))
        first = spark.sparkContext.broadcast(asked)
        asked = replace(asked, limits=_limits(blocks, asked, first, k))
        second = spark.sparkContext.broadcast(asked)
        results.append(written(_rescored(blocks, second, k)))
        first.unpersist()
        second.unpersist()
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(written(index(docs)), items)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS terms FROM documents),
sized AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term FROM benchmark),
weighted AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM asked JOIN df USING (term), total),
scores AS (
  SELECT item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM weighted JOIN tf USING (term), total WHERE doc_id IS NOT NULL GROUP BY item_id, row_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
