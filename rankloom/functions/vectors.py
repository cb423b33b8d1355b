"""Vector column functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import code_tokens

HASH_DIMS = 64
HASH_ROWS = 512  # rows whose vectors are made at once
HASHED = "vec array<struct<dim: int, v: double>>"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays zero."""
    size = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))


def rounded_literal(v: Column, digits: int = 6) -> Column:
    """The vector as it survives a decimal text form of ``digits`` places."""
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def _slots(words: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every word, from the first 32 bits of its digest."""
    number = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words], np.int64)
    return number % dims, number // dims % 2 * 2 - 1


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _hashing(keys: list[str], dims: int) -> Batches:
    """Rows of keys and tokens to rows of keys and sparse vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            coded = lists.flatten().dictionary_encode()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            dim, sign = _slots(coded.dictionary.to_pylist(), dims)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, batch.num_rows, HASH_ROWS):
                size = sizes[at : at + HASH_ROWS]
                code = codes[starts[at] : starts[at + len(size)]]
                cell = np.repeat(np.arange(len(size)), size) * dims + dim[code]
                found, place = np.unique(cell, return_inverse=True)
                pairs = pa.StructArray.from_arrays([pa.array(found % dims, pa.int32()), pa.array(np.bincount(place, sign[code], len(found)))], names=["dim", "v"])
                ends = np.searchsorted(found, np.arange(len(size) + 1) * dims)
                named = [c.slice(at, len(size)) for c in batch.columns[:len(keys)]]
                yield pa.RecordBatch.from_arrays([*named, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[*keys, "vec"])

    return run


def hashed_batches(units: DataFrame, keys: list[str], text: Column, dims: int = HASH_DIMS) -> tuple[DataFrame, Batches]:
    """Rows of tokens and what turns their batches into ``hashed_vectors``, for a caller that goes on in the same worker."""
    return units.select(*keys, code_tokens(text).alias("tokens")), _hashing(keys, dims)


def hashed_vectors(units: DataFrame, keys: list[str], text: Column, dims: int = HASH_DIMS) -> DataFrame:
    """Offline vectoriser: signed counts of hashed tokens, as sparse (dim, v) pairs in ``vec``.

    Row-local: a batch hashes each of its distinct tokens once and sums the signs of every row, so nothing is shuffled.
    Sums are made for ``HASH_ROWS`` rows at a time, so the work arrays do not grow with the batch.
    """
    rows, made = hashed_batches(units, keys, text, dims)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(made, f"{kinds}, {HASHED}")
