"""Exchange of keys between batches of documents and buckets of keys, in packed rows.

Documents are dealt into batches by a hash and travel once, compressed. A batch sends every distinct key of its
texts once, as one packed row for each bucket (a range of the key hash). A bucket task sees each key at most
once from each batch, so no key is hot however often it occurs. Its answers go back as one packed row for each
batch, in the order of the batch's keys, and meet the batch's documents again.

Spark plans, shuffles and retries all of it; a task holds one batch or one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import width

DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])
KEYS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
ANSWERS = "batch int, bucket int, data binary"

Forward = Callable[[pa.Table], Iterator[tuple[int, bytes]]]
Resolve = Callable[[list[bytes]], list[bytes]]
Finish = Callable[[pa.Table, list[bytes]], pa.Table]


def to_blob(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def from_blobs(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]) if blobs else DOC_SCHEMA.empty_table()


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def stretch(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit values byte plane by byte plane, so that small values compress away."""
    return squeeze(b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def from_planes(data: bytes, columns: int = 1) -> list[np.ndarray]:
    whole = np.frombuffer(stretch(data), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").ravel() for c in whole]


def gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; ``np.cumsum`` restores them."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets are equal ranges of the high half."""
    tops = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
    return np.concatenate([[0], np.searchsorted(keys, tops << np.uint64(32)), [len(keys)]])


def pack(docs: DataFrame, doc_id: str, text: str, batches: int) -> DataFrame:
    """(batch, data) rows of compressed documents; every row of ``docs`` is in exactly one."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(batches)).cast("int").alias("batch"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.Table.from_batches([part]).sort_by("batch")
            ids = table.column("batch").to_numpy()
            marks = np.flatnonzero(np.diff(ids, prepend=-1))
            found, blobs = [], []
            for a, b in zip(marks, [*marks[1:], len(ids)], strict=True):
                found.append(int(ids[a]))
                blobs.append(to_blob(table.slice(a, b - a).select(["doc_id", "text"]).cast(DOC_SCHEMA).combine_chunks()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "data"])

    return rows.mapInArrow(run, "batch int, data binary")


def exchange(docs: DataFrame, doc_id: str, text: str, forward: Forward, resolve: Resolve, finish: Finish, schema: str) -> DataFrame:
    """``forward`` gives (bucket, packed keys) of a batch, ``resolve`` answers the packed keys that one bucket
    got, in their order, and ``finish`` turns a batch and its answers in bucket order into rows of ``schema``."""
    batches = 2 * width(docs.sparkSession)
    packed = pack(docs, doc_id, text, batches)

    def send(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        sent = list(forward(from_blobs(group.column("data").to_pylist())))
        return pa.table([[batch] * len(sent), [b for b, _ in sent], [d for _, d in sent]], schema=KEYS)

    def answer(group: pa.Table) -> pa.Table:
        return pa.table([group.column("batch"), group.column("bucket"), pa.chunked_array([pa.array(resolve(group.column("data").to_pylist()), pa.binary())])], schema=KEYS)

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.sort_by("bucket").column("data").to_pylist()
        return finish(from_blobs(left.column("data").to_pylist()), answers)

    keys = packed.groupBy("batch").applyInArrow(send, ANSWERS)
    answers = keys.groupBy("bucket").applyInArrow(answer, ANSWERS)
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(gather, schema)
