"""Document fingerprints: a digest of the quartiles of hashed byte triplets and of the length.

Every byte of a text opens triplets with two of the bytes that follow it (``TRIPLES``). Each kind of triplet is hashed
into ``BUCKETS`` counters by tables of its own. The digest holds two bits for each counter (above which of the three
quartiles of all counters it lies), the ratios of the quartiles, and the logarithm of the length. Two digests differ by
the sum of bounded differences: of the counters' codes, of the ratios and of the lengths; likeness is one less that
difference's share of the largest possible one, so equal digests have likeness 1 and the range is 0 to 1.

``fingerprints`` digests one text for each row in the scan, without a shuffle. ``neighbours`` puts the documents in
descending order of doc_id over range partitions (one exchange of the text; equal ids are spread by a hash and the
row's position, so that no id is hot), and compares each text with the one that follows it and with an edited copy of
itself. Only the first and last row of a partition meet rows of another one.

Defined results: null is the empty text, whose digest has all codes 0; texts of fewer than three bytes have no triplet
and differ from it by length only; in the order a null doc_id comes last, and rows of equal doc_id follow by a hash of
the text; the last row is followed by the first, a single row by itself; repeated rows are rows of their own; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays
from rankloom.llm.tables import slices, width, written

BUCKETS = 512
TRIPLES = [(1, 2), (1, 3), (2, 3)]
LENGTH_BASE, LENGTH_BOUND, RATIO_STEPS, RATIO_BOUND, FAR_CODES = 1.15, 24, 16, 8, 4
LARGEST = BUCKETS * FAR_CODES + LENGTH_BOUND + 2 * RATIO_BOUND
_TABLES = [[(arrays._mixed(256, 31 + 3 * k + i) & np.uint64(BUCKETS - 1)).astype(np.uint16) for i in range(3)] for k in range(len(TRIPLES))]


def bucket_counts(texts: pa.Array) -> np.ndarray:
    """Counters of each text, one row for each."""
    body, starts = arrays.raw(texts)
    n = len(starts) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    out = np.zeros(n * BUCKETS, np.int64)
    for (i, j), (first, second, third) in zip(TRIPLES, _TABLES, strict=True):
        if len(body) <= j:
            continue
        bucket = first[body[:-j]] ^ second[body[i:len(body) - j + i]] ^ third[body[j:]]
        whole = owner[:-j] == owner[j:]
        out += np.bincount((owner[:-j] * BUCKETS + bucket)[whole], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(texts: pa.Array) -> np.ndarray:
    """One row of bytes for each text: length code, two ratio codes, then the code of every counter."""
    counts = bucket_counts(texts)
    cuts = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.empty((len(counts), BUCKETS + 3), np.uint8)
    size = np.diff(arrays.raw(texts)[1])
    out[:, 0] = np.minimum(255, np.floor(np.log1p(size) / math.log(LENGTH_BASE)))
    top = np.maximum(1, cuts[:, 2])
    out[:, 1] = cuts[:, 0] * (RATIO_STEPS - 1) // top
    out[:, 2] = cuts[:, 1] * (RATIO_STEPS - 1) // top
    out[:, 3:] = (counts[:, :, None] > cuts[:, None, :]).sum(axis=2)
    return out


def packed(digest: np.ndarray) -> list[bytes]:
    """Digests as bytes: a byte of length, a byte of both ratios, two bits for each counter."""
    codes = digest[:, 3:].reshape(len(digest), -1, 4)
    body = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    head = np.stack([digest[:, 0], digest[:, 1] * RATIO_STEPS + digest[:, 2]], axis=1)
    return [x.tobytes() for x in np.hstack([head, body])]


def as_text(digest: str) -> Column:
    """A packed digest in lowercase hexadecimal."""
    return F.lower(F.hex(digest)).alias(digest)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row: whole numbers from 0 to ``LARGEST``."""
    gap = np.abs(a.astype(np.int64) - b.astype(np.int64))
    codes = np.where(gap[:, 3:] == 3, FAR_CODES, gap[:, 3:]).sum(axis=1)
    return codes + np.minimum(gap[:, 0], LENGTH_BOUND) + np.minimum(gap[:, 1:3], RATIO_BOUND).sum(axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / LARGEST


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(digests(part.column(1))), pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint binary").select(
        "doc_id", as_text("fingerprint"))


# ------------------------------------------------------------------------------------------- each text and the next

COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
            "near_edited double, near_next double")
ENDS = "part int, is_head boolean, is_tail boolean, text string"
NAMES = [c.split()[0] for c in f"{COMPARED}, {ENDS}".split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.large_string()]


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _compared(ids: list, texts: list[str], following: list[str]) -> list[list]:
    """Columns of ``COMPARED`` for rows and the texts that follow them."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, other, new = (digests(pa.array(t, pa.large_string())) for t in (texts, following, changed))
    return [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], packed(own), packed(new),
            likeness(own, new).tolist(), likeness(own, other).tolist()]


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=False)], names=NAMES[:len(columns)])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered partition: compared with their next; the first and the last also (or only) as ends."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    first: tuple | None = None
    for batch in batches:
        for rows in slices(batch, "text"):
            ids = rows.column(0).to_pylist()
            texts = [t or "" for t in rows.column(1).to_pylist()]
            if held is None:
                first = (ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                none = [None] * (len(ids) - 1)
                yield _batch([*_compared(ids[:-1], texts[:-1], texts[1:]), none, none, none, none])
    if held is not None:
        none = [[None] * 2] * 6
        yield _batch([[held[0], first[0]], *none, [part, part], [False, True], [True, False], [held[1], first[1]]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for (doc_id, text, following) rows."""
    for batch in batches:
        for rows in slices(batch, "text"):
            yield _batch(_compared(rows.column(0).to_pylist(), *[[t or "" for t in rows.column(k).to_pylist()] for k in (1, 2)]))


def in_order(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, text) in descending order over range partitions."""
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).select(
        "*", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_p"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_p")]
    return rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited copy and the likeness to that and to the next document."""
    rows = written(in_order(docs, F.col(doc_id), F.col(text)).mapInArrow(_walk, f"{COMPARED}, {ENDS}"))
    # Two rows for each partition; only their numbers meet in one place.
    heads = rows.where("is_head").select("part", F.col("text").alias("following"))
    numbers = heads.select("part")
    first = F.min("part").over(Window.partitionBy(F.lit(1)))
    after = numbers.select(F.col("part").alias("_part"), F.coalesce(F.lead("part").over(Window.orderBy("part")), first).alias("part"))
    tails = rows.where("is_tail").select("part", "doc_id", "text").withColumnRenamed("part", "_part").join(after, "_part").join(heads, "part")
    every = rows.where("part IS NULL").select(NAMES[:7]).unionByName(tails.select("doc_id", "text", "following").mapInArrow(_across, COMPARED))
    return every.select(*[as_text(c) if c.endswith("fingerprint") else c for c in NAMES[:7]])


def query(docs: DataFrame) -> DataFrame:
    return neighbours(docs.select("doc_id", "text"))
