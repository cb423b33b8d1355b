"""Stupid-backoff scores of every document against n-gram counts of all documents.

The score of a word is the relative frequency of the longest n-gram that ends in it and was counted at least
``min_count`` times, times ``backoff`` for each order given up; single words are never pruned. The counts are
tables partitioned by n-gram hash; exploded n-grams of a batch of documents join them through ``blocks`` and
the logarithms are summed for each document.

Words are runs of characters other than space and ``\\t`` to ``\\r``. Defined results: a null or empty text has
no words, log_score 0 and mean_log_score null; repeated rows are counted and scored each; a null doc_id stays;
extra columns are ignored. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm import arrays, blocks
from rankloom.llm.tables import slices, width

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
TOTAL = np.uint64(0x5DEECE66D1234567)
SCHEMA = "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double"


def _grams(docs: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the hash of every n-gram and the index of its first word; word bounds of the texts."""
    word, sizes = [], []
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, "text"):
            w, bounds = arrays.words(part.column(1))
            word.append(w)
            sizes.append(np.diff(bounds))
    words = np.concatenate([*word, np.zeros(0, np.uint64)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
    found = [arrays.windows(words, bounds, n, seed=n) for n in range(1, order + 1)]
    return [h for h, _ in found], [i for _, i in found], bounds


def _distinct(hashes: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys in order with their counts; the number of words goes under a key of its own."""
    keys, counts = np.unique(np.concatenate([*hashes, np.array([TOTAL])]), return_counts=True)
    counts[np.searchsorted(keys, TOTAL)] = n_words
    return keys, counts.astype(np.uint64)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF,
          min_count: int = MIN_COUNT) -> DataFrame:
    buckets = 2 * width(docs.sparkSession)

    def forward(batch: pa.Table) -> Iterator[tuple[int, bytes]]:
        hashes, _, bounds = _grams(batch, order)
        keys, counts = _distinct(hashes, int(bounds[-1]))
        edges = blocks.bucket_bounds(keys, buckets)
        for b in range(buckets):
            a, z = edges[b], edges[b + 1]
            if z > a:
                yield b, blocks.planes(blocks.gaps(keys[a:z]), counts[a:z])

    def resolve(sent: list[bytes]) -> list[bytes]:
        pairs = [blocks.from_planes(d, 2) for d in sent]
        keys = [np.cumsum(gap, dtype=np.uint64) for gap, _ in pairs]
        every = np.concatenate(keys)
        order_ = np.argsort(every, kind="stable")
        ranked = every[order_]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.concatenate([n for _, n in pairs])[order_]
        total = np.add.reduceat(counts, first)
        back = np.empty(len(every), np.uint64)
        back[order_] = np.repeat(total, np.diff(np.append(first, len(every))))
        return [blocks.planes(x) for x in np.split(back, np.cumsum([len(k) for k in keys])[:-1])]

    def finish(batch: pa.Table, answers: list[bytes]) -> pa.Table:
        hashes, firsts, bounds = _grams(batch, order)
        keys, _ = _distinct(hashes, 0)
        counts = np.concatenate([blocks.from_planes(a)[0] for a in answers])
        if len(counts) != len(keys):
            raise RuntimeError("answers do not match the batch's n-grams")
        n = int(bounds[-1])
        total = float(counts[np.searchsorted(keys, TOTAL)])
        sizes = np.diff(bounds)
        reach = np.minimum(np.arange(n) - np.repeat(bounds[:-1], sizes) + 1, order).astype(np.int8)
        used = np.ones(n, np.int8)
        value = last = np.zeros(0)
        for k in range(1, order + 1):
            h, first = hashes[k - 1], firsts[k - 1]
            hashes[k - 1] = firsts[k - 1] = None
            # The count of the n-gram that begins at each word; 0 where it is pruned or absent.
            own = np.zeros(n)
            unique, inverse = np.unique(h, return_inverse=True)
            own[first] = counts[np.searchsorted(keys, unique)][inverse]
            del h, first, unique, inverse
            if k == 1:
                value = own / max(total, 1.0)
            elif n >= k:
                own[own < min_count] = 0
                seen = np.flatnonzero((own[:n - k + 1] > 0) & (reach[k - 1:] >= k))
                value[seen + k - 1] = own[seen] / last[seen]
                used[seen + k - 1] = k
            last = own
        logs = np.log(value) + (reach - used) * np.log(backoff)
        sums, backed = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(logs, bounds[:-1][full])
            backed[full] = np.add.reduceat((used < reach).astype(np.int64), bounds[:-1][full])
        mean = pa.array(np.round(sums / np.maximum(sizes, 1), 6), mask=sizes == 0)
        return pa.table({"doc_id": batch.column("doc_id"), "n_words": sizes.astype(np.int64), "n_backed_off": backed,
                         "log_score": np.round(sums, 3), "mean_log_score": mean})

    return blocks.exchange(docs, doc_id, text, forward, resolve, finish, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_backed_off", "mean_log_score")


SQL = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM rows_),
grams AS (
  SELECT r, i, w AS c, lag(w) OVER d AS b, lag(w, 2) OVER d AS a FROM words WINDOW d AS (PARTITION BY r ORDER BY i)),
one AS (SELECT c, count(*) AS n1 FROM grams GROUP BY c),
two AS (SELECT b, c, count(*) AS n2 FROM grams WHERE b IS NOT NULL GROUP BY b, c HAVING count(*) >= 2),
three AS (SELECT a, b, c, count(*) AS n3 FROM grams WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
scored AS (
  SELECT g.r, g.i, least(g.i, 3) AS reach,
    CASE WHEN t.n3 IS NOT NULL THEN 3 WHEN bc.n2 IS NOT NULL THEN 2 ELSE 1 END AS used,
    CASE WHEN t.n3 IS NOT NULL THEN t.n3 / ab.n2::DOUBLE WHEN bc.n2 IS NOT NULL THEN bc.n2 / ob.n1::DOUBLE
      ELSE oc.n1 / (SELECT count(*) FROM words)::DOUBLE END AS v
  FROM grams g JOIN one oc ON oc.c = g.c LEFT JOIN one ob ON ob.c = g.b
  LEFT JOIN two bc ON bc.b = g.b AND bc.c = g.c LEFT JOIN two ab ON ab.b = g.a AND ab.c = g.b
  LEFT JOIN three t ON t.a = g.a AND t.b = g.b AND t.c = g.c)
SELECT any_value(rows_.doc_id) AS doc_id, count(s.r) AS n_words, count(*) FILTER (s.used < s.reach) AS n_backed_off,
  round(sum(ln(s.v) + (s.reach - s.used) * ln(0.4)) / count(s.r), 6) AS mean_log_score
FROM rows_ LEFT JOIN scored s ON s.r = rows_.r GROUP BY rows_.r
"""
