"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence's probability is logistic in its words and their beginnings (4 to 6 bytes), hashed; a document is
toxic if at least one sentence is: ``1 - prod(1 - p)``. The weights minimise the document's cross-entropy, so the
gradient of a toxic document goes to the sentences that explain it. Scored texts name those sentences.

Fitting uses at most ``MAX_PER_CLASS`` labelled documents of each class, chosen by a hash of doc_id, in one task.
Each class weighs in the gradient as it does among all training labels, so a capped sample keeps their prior;
scoring reads all texts once without a shuffle, with a broadcast of ``2 ** BITS`` weights.

Sentences end at ``.``, ``!``, ``?`` and line ends. Defined results: a null, empty or wordless text has the score
of a sentence without words; without labels of both kinds the score is 0.5 times the share of toxic labels in
the sample (0 without labels); repeated labels of a document count as toxic if one does; null labels and labels
without a document are not used; a null doc_id is never held out; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import arrays
from rankloom.llm.tables import slices

BITS, MAX_PER_CLASS, THRESHOLD = 20, 6000, 0.3
PREFIXES = (4, 5, 6)
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STOP = np.zeros(256, bool)
STOP[[33, 46, 63, 10]] = True
SCHEMA = ("doc_id long, held_out boolean, score double, n_sentences long, "
          "offending array<struct<start:long,end:long,score:double>>")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices (words x kinds), first word of each sentence, its text, and (begin, end) of the words."""
    body, starts = arrays.raw(texts)
    begin, end = arrays.spans(body, starts, GAP)
    lower = LOWER[body]
    kinds = [arrays.hashes(lower, begin, np.minimum(end, begin + k), seed=20 + k) for k in PREFIXES]
    index = np.stack([arrays.hashes(lower, begin, end, seed=20), *kinds], axis=1) >> np.uint64(64 - BITS)
    text = np.searchsorted(starts, begin, side="right") - 1
    stops = np.cumsum(STOP[body])[begin] if len(begin) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])])) if len(begin) else np.zeros(0, np.int64)
    return index.astype(np.int64), new, text[new], np.stack([begin, end], axis=1)


def _sentence_scores(index: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(first):
        return np.zeros(0)
    z = np.add.reduceat(weights[index].sum(axis=1), first) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _any(p: np.ndarray, text: np.ndarray, count: int, bias: float) -> np.ndarray:
    """Noisy-or of each text's sentences; a text without any counts as one empty sentence."""
    none = np.bincount(text, weights=np.log1p(-np.minimum(p.astype(np.float64), 1 - 1e-12)), minlength=count)
    empty = np.bincount(text, minlength=count) == 0
    return np.where(empty, 1 / (1 + np.exp(-bias)), -np.expm1(none))


def _all_features(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of the texts, made slice by slice, and the features that at least ``least`` texts have."""
    parts, seen, words, docs = [], np.zeros(1 << BITS, np.int64), 0, 0
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        index, first, text, _ = features(part.column(0))
        owner = np.repeat(text, np.diff(np.append(first, len(index))))
        pairs = np.unique((index + (owner[:, None] << BITS)).ravel())
        seen += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        parts.append((index.astype(np.int32), first + words, text + docs))
        words, docs = words + len(index), docs + part.num_rows
    index, first, text = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return index, first, text, seen >= least


def fit(texts: pa.Array, toxic: np.ndarray, stands_for: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.3,
        decay: float = 3e-4, least: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad. Features of fewer than ``least`` documents keep no weight: rare words would
    only be learned by heart. ``stands_for`` is the number of training labels that each document stands for."""
    share = stands_for / stands_for.mean()
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    bias, bias_square = -4.0, 1e-6
    index, first, text, frequent = _all_features(texts, least)
    bounds = np.append(first, len(index))
    doc = np.searchsorted(text, np.arange(len(texts) + 1))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        deal = order.permutation(len(texts))
        for start in range(0, len(texts), batch):
            own = deal[start:start + batch]
            sentence = np.concatenate([np.arange(doc[d], doc[d + 1]) for d in own])
            if not len(sentence):
                continue
            words = np.concatenate([np.arange(bounds[s], bounds[s + 1]) for s in sentence])
            size = bounds[sentence + 1] - bounds[sentence]
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            used = index[words]
            p = _sentence_scores(used, at, weights, bias)
            owner = np.repeat(np.arange(len(own)), doc[own + 1] - doc[own])
            whole = np.clip(_any(p, owner, len(own), bias), 1e-9, 1 - 1e-9)
            pull = np.where(toxic[own] == 1, -(1 - whole) / whole, 1.0) * share[own]
            grad = pull[owner] * p / len(own)
            flat = used.ravel()
            spread = np.repeat(np.repeat(grad, size), used.shape[1])
            touched, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, weights=spread) + decay * weights[touched]
            squares[touched] += g * g
            weights[touched] -= frequent[touched] * rate * g / np.sqrt(squares[touched])
            g = float(grad.sum())
            bias_square += g * g
            bias -= rate * g / bias_square ** 0.5
    return weights.astype(np.float32), bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Up to ``max_per_class`` documents of each class outside the held-out fold: doc_id, text, toxic, and
    stands_for, the labels of the class for each of its documents in the sample."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(17))
    # At most 2 * max_per_class narrow rows, so the broadcast is bounded by the parameter.
    chosen = marks.where("toxic = 1").orderBy(order, "doc_id").limit(max_per_class).union(
        marks.where("toxic = 0").orderBy(order, "doc_id").limit(max_per_class))
    counts = marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("_all")).select(
        "toxic", (F.col("_all") / F.least("_all", F.lit(max_per_class))).alias("stands_for"))
    weighed = F.broadcast(chosen.join(F.broadcast(counts), "toxic"))
    return docs.select("doc_id", "text").join(weighed, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("stands_for").alias("stands_for"))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32()), ("stands_for", pa.float64())])).sort_by("doc_id")
        toxic = rows.column("toxic").to_numpy()
        if not len(toxic) or toxic.min() == toxic.max():
            share = float(toxic.mean()) / 2 if len(toxic) else 0.0
            weights, bias = np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-12) / (1 - share)))
        else:
            weights, bias = fit(rows.column("text").combine_chunks(), toxic, rows.column("stands_for").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    labelled = sample(docs, labels, max_per_class).select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int"), "stands_for")
    row = labelled.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return (np.frombuffer(row[0], np.float32), row[1]) if row else (np.zeros(1 << BITS, np.float32), -27.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, n_sentences and the sentences with a probability of at least a half, by
    character offsets."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                index, first, owner, span = features(part.column(2))
                p = _sentence_scores(index, first, w, b)
                count = part.num_rows
                bad: list[list[dict]] = [[] for _ in range(count)]
                marked = np.flatnonzero(p >= 0.5)
                if len(marked):
                    body, starts = arrays.raw(part.column(2))
                    chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                    last = np.append(first[1:], len(index)) - 1
                    for s in marked.tolist():
                        zero = chars[starts[owner[s]]]
                        bad[owner[s]].append({"start": int(chars[span[first[s], 0]] - zero), "end": int(chars[span[last[s], 1]] - zero), "score": float(p[s])})
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(_any(p, owner, count, b)),
                    pa.array(np.bincount(owner, minlength=count).astype(np.int64)), pa.array(bad, kind)],
                    names=["doc_id", "held_out", "score", "n_sentences", "offending"])

    return rows.mapInArrow(run, SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = train(docs, labels)
    return score(docs, weights, bias).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending")
