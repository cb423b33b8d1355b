"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of ASCII letters and digits and of other characters outside ASCII. Seeds are the
Karp-Rabin hashes of ``MIN_MATCH`` tokens that a document shares with a benchmark item; consecutive seeds on one
diagonal are a match. The longest match whose tokens are all free on both sides becomes a tile; matches that
overlap it are cut down to their free parts and stand again, until none of ``MIN_MATCH`` tokens is left. The
tiles need not keep their order, so a passage is found after its sentences were shuffled. A document is
contaminated by an item if the tiles cover at least ``COVERAGE`` of the item's tokens.

Scale: the document side is one scan without a shuffle. Benchmark items are cut into blocks of about
``BLOCK_TOKENS`` tokens, each of which is broadcast on its own; the blocks follow from a count of the table. With
more than one block the result is written after each, and the block released: neither the driver nor an executor
holds two of them.

Defined results: null and empty texts match nothing, on either side; an item with fewer than ``MIN_MATCH``
tokens has one seed of its own length, so it is matched where it stands as a whole; items with equal text are reported each, as are repeated rows; a null
doc_id or item_id stays; extra columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import arrays
from rankloom.llm.tables import slices, written

MIN_MATCH, COVERAGE, BLOCK_TOKENS = 5, 0.5, 1_000_000
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("reordered", pa.bool_())]))
SCHEMA = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("n_tiles", T.IntegerType()), T.StructField("reordered", T.BooleanType())]))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token in order, and the token bounds of each text."""
    body, starts = arrays.raw(pc.utf8_lower(texts))
    begin, end = arrays.spans(body, starts, GAP)
    return arrays.hashes(body, begin, end), np.searchsorted(begin, starts)


def tile(doc_at: np.ndarray, item_at: np.ndarray, doc_size: int, item_size: int, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, length) from the places of shared seeds."""
    shift = doc_at - item_at
    order = np.lexsort((doc_at, shift))
    p, s = doc_at[order], shift[order]
    cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)]))
    size = np.diff(np.append(cut, len(p))) + least - 1
    heap = [(-int(n), int(a), int(a - d)) for n, a, d in zip(size, p[cut], s[cut], strict=True)]
    heapq.heapify(heap)
    doc_used, item_used = np.zeros(doc_size, bool), np.zeros(item_size, bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        used = doc_used[a:a - n] | item_used[b:b - n]
        if not used.any():
            doc_used[a:a - n] = item_used[b:b - n] = True
            tiles.append((a, b, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], used, [1]]).astype(np.int8)))
        for start, stop in edges.reshape(-1, 2).tolist():
            if stop - start >= least:
                heapq.heappush(heap, (start - stop, a + start, b + start))
    return sorted(tiles)


class Items:
    """One block of benchmark items with their seeds in hash order."""

    def __init__(self, rows: list, least: int) -> None:
        """``rows`` are (id, text) with at least ``least`` tokens each."""
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        self.ids = [r[0] for r in rows]
        token, bounds = tokens(pa.array([r[1] for r in rows], pa.string()))
        self.size = np.diff(bounds)
        seed, first = arrays.windows(token, bounds, least)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        owner = np.searchsorted(bounds, first, side="right") - 1
        self.owner, self.place = owner[order], (first - bounds[owner])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.least = least

    def matches(self, texts: pa.Array, coverage: float) -> dict[int, list[dict]]:
        """Contaminating items by the index of the text."""
        token, bounds = tokens(texts)
        seed, first = arrays.windows(token, bounds, self.least)
        could = np.flatnonzero(self.maybe[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.seed, seed[could], side=s) for s in ("left", "right"))
        hit = high > low
        if not hit.any():
            return {}
        could, low, reps = could[hit], low[hit], (high - low)[hit]
        at = np.repeat(first[could], reps)
        which = np.repeat(low - np.cumsum(reps) + reps, reps) + np.arange(int(reps.sum()))
        text = np.searchsorted(bounds, at, side="right") - 1
        order = np.lexsort((self.owner[which], text))
        at, which, text = at[order], which[order], text[order]
        owner = self.owner[which]
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1])]))
        out: dict[int, list[dict]] = {}
        for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
            t, item = int(text[a]), int(owner[a])
            need = coverage * self.size[item]
            # Tiles lie on seeds: too few distinct places of the item cannot cover it.
            if len(np.unique((self.place[which[a:b]][:, None] + np.arange(self.least)).ravel())) < need - 1e-9:
                continue
            found = tile(at[a:b] - bounds[t], self.place[which[a:b]], int(bounds[t + 1] - bounds[t]), int(self.size[item]), self.least)
            share = sum(n for _, _, n in found) / self.size[item]
            if share >= coverage - 1e-12:
                starts = [q for _, q, _ in found]
                out.setdefault(t, []).append({"item_id": self.ids[item], "coverage": float(share), "n_tiles": len(found), "reordered": starts != sorted(starts)})
        return out


def seeded(rows: list, least: int) -> list[Items]:
    """Items by the length of their seeds: ``least`` tokens, or all of a shorter item."""
    held: dict[int, list] = {}
    for row, n in zip(rows, np.diff(tokens(pa.array([r[1] for r in rows], pa.string()))[1]).tolist() if rows else [], strict=True):
        if n:
            held.setdefault(min(n, least), []).append(row)
    return [Items(held[n], n) for n in sorted(held)]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, least: int, block_tokens: int) -> Iterator[tuple[bool, list[Items]]]:
    """(more follow, items): the benchmark in blocks of a bounded size, read one by one; item lengths decide how many there are."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    # A token has at least one character and a gap, so half the characters bound the tokens.
    total = rows.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // block_tokens))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield k < count - 1, seeded([tuple(r) for r in rows.where(part == k).collect()], least)


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 least: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with the column ``matches``: the items that contaminate the row."""
    out = docs.drop("matches").withColumn("matches", F.array().cast(SCHEMA))
    place = out.columns.index(text)
    for more, block in item_blocks(benchmark, item_id, item_text, least, block_tokens):
        sent = docs.sparkSession.sparkContext.broadcast([vars(items) for items in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = []
            for values in sent.value:
                known.append(Items.__new__(Items))
                vars(known[-1]).update(values)
            for batch in batches:
                name = batch.schema.names[place]
                for part in slices(batch, name):
                    hits: dict[int, list[dict]] = {}
                    for items in known:
                        for k, found in items.matches(part.column(place), coverage).items():
                            hits.setdefault(k, []).extend(found)
                    had = part.column(part.num_columns - 1)
                    if hits:
                        had = pa.array([[*(x or []), *hits.get(k, [])] for k, x in enumerate(had.to_pylist())], FOUND)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], had.cast(FOUND)], names=part.schema.names)

        out = out.mapInArrow(run, out.schema)
        if more:
            out = written(out)
            sent.unpersist()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item that contaminates it."""
    found = with_matches(docs, benchmark, **options).where("size(matches) > 0")
    return found.select(F.col(doc_id), F.explode("matches").alias("m")).select(doc_id, "m.item_id", "m.coverage", "m.n_tiles", "m.reordered")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    return with_matches(docs, benchmark, **options).where("size(matches) = 0").select(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs.select("doc_id", "text"), benchmark)
