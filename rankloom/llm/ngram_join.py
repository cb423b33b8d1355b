"""N-gram Jaccard join: a MinHash LSH forest finds candidate pairs, exact shingle sets decide.

Texts are sets of runs of ``n`` words (shorter texts: one run of all their words). Equal word sequences are one
text: a row for each text goes on, so copies cost nothing further. Each text gets ``TREES`` signatures of
``DEPTH`` values, the paths of a text in as many prefix tries. The join looks at texts that share a prefix, the
longest one that finds a pair right at the threshold with the target recall; more similar pairs are found more
surely, and what else the table holds does not matter. Sketches of the signatures discard unlikely pairs, the rest
form candidate groups, and inside a group every pair is compared exactly.

Nothing is emitted for each pair: a task compares blocks of a group as matrices and returns for each text its
number of partners and a spanning link. Groups and trie nodes of any size are cut into blocks of ``BLOCK`` texts,
and every two blocks of a group meet in one task.

Result: one row for each row of the input: doc_id, class_id (smallest doc_id of all texts connected by links,
the row's own if there are none), n_copies (rows with the same text), n_links (other texts with a Jaccard
similarity of at least ``threshold``). Defined results: null, empty or blank texts have no shingles, so no
copies and no links, and are classes of their own; a null doc_id takes part, and its class_id is null only if no
row of the class has a doc_id; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays
from rankloom.llm.tables import slices, width, written

TREES, DEPTH = 16, 8
SIZE = TREES * DEPTH
N, THRESHOLD, RECALL, BLOCK = 5, 0.8, 0.999, 256
SLACK = 4 * (0.8 * 0.2 / SIZE) ** 0.5  # four standard errors of a similarity estimated from SIZE values


def _shingles(word: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and their bounds; a text of fewer than n words has one."""
    hashes, first = arrays.windows(word, bounds, n)
    size = np.diff(bounds)
    counts = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    long = np.repeat(size >= n, counts)
    out[long] = hashes
    for k in np.flatnonzero((size > 0) & (size < n)):
        own, _ = arrays.windows(word[bounds[k]:bounds[k + 1]], np.array([0, size[k]]), int(size[k]), seed=100 + int(size[k]))
        out[out_bounds[k]] = own[0]
    return out, out_bounds


def _sequence_hash(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's words in order."""
    size = np.diff(bounds)
    place = np.arange(len(word)) - np.repeat(bounds[:-1], size)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    with np.errstate(over="ignore"):
        mixed = arrays.scramble(word + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if len(full):
            out[full] = np.add.reduceat(mixed, bounds[:-1][full])
        return arrays.scramble(out + size.astype(np.uint64))


def _signatures(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SIZE minima of affine maps of the 32 high bits; rows of texts without shingles stay at the maximum."""
    low = (shingle >> np.uint64(32)).astype(np.uint32)
    factors = (arrays._mixed(SIZE, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    terms = (arrays._mixed(SIZE, 12) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, SIZE), np.uint32(0xFFFFFFFF), np.uint32)
    if len(full):
        starts = bounds[:-1][full]
        for k in range(SIZE):
            x = low * factors[k] + terms[k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[full, k] = np.minimum.reduceat(x, starts)
    return out


def sketch(docs: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (hash of the raw text), node (hash of the word sequence, null without words), sig."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                word, bounds = arrays.words(part.column(2))
                sig = _signatures(*_shingles(word, bounds, n))
                empty = np.diff(bounds) == 0
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(_sequence_hash(word, bounds).view(np.int64), mask=empty),
                    pa.array([x.tobytes() for x in sig], pa.binary(), mask=empty)], names=["doc_id", "key", "node", "sig"])

    return rows.mapInArrow(run, "doc_id long, key long, node long, sig binary")


def _paths(texts: DataFrame, depth: int) -> DataFrame:
    """(path, node): the hash of each text's prefix of the given length in every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            path = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(32), sig.shape[:2]).copy()
            with np.errstate(over="ignore"):
                for k in range(depth):
                    path = arrays.scramble(path * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            node = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(node)], names=["path", "node"])

    return texts.select("node", "sig").mapInArrow(run, "path long, node long")


def _blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Adds (left, right, side): every two blocks of a group meet; side says which of the two a row is in."""
    count = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = members.withColumn("_n", count).withColumn("_b", F.pmod(F.xxhash64(F.col("node"), F.lit(group)), F.col("_n")).cast("int"))
    return own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        *members.columns, F.least("_b", "_o").alias("left"), F.greatest("_b", "_o").alias("right"),
        (F.col("_b") > F.col("_o")).alias("second"))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``by``, one table at a time, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        marks = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(marks, marks[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Links:
    """Partners and a spanning forest of the members of one block pair."""

    def __init__(self, count: int) -> None:
        self.root = np.arange(count)
        self.partners = np.zeros(count, np.int64)

    def _find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, k: int, others: np.ndarray) -> None:
        """Links member k to the others."""
        if len(others):
            self.partners[k] += len(others)
            self.partners[others] += 1
            mine = self._find(k)
            for other in np.unique(self.root[others]):
                theirs = self._find(other)
                low, high = min(mine, theirs), max(mine, theirs)
                self.root[high] = low
                mine = low

    def roots(self) -> np.ndarray:
        return np.array([self._find(k) for k in range(len(self.root))], np.int64)


def _likely(group: pa.Table, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs whose sketches agree enough."""
    node = group.column("node").to_numpy()
    second = group.column("second").to_numpy(zero_copy_only=False)
    low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(node), SIZE)
    links = _Links(len(node))
    across = bool(second.any())
    for k in range(len(node) - 1):
        rest = np.arange(k + 1, len(node))
        if across:
            rest = rest[second[rest] != second[k]]
            if not len(rest):
                continue
        share = ((low[rest] == low[k]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        links.join(k, rest[share >= cutoff])
    return node, node[links.roots()]


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair of similarity ``threshold`` in one of the tries with the given probability."""
    for level in range(DEPTH, 0, -1):
        if 1 - (1 - threshold ** level) ** TREES >= recall:
            return level
    raise ValueError(f"{TREES} tries cannot find pairs of similarity {threshold} with a recall of {recall}")


def candidate_links(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, root) links that connect every candidate pair."""
    paths = _paths(texts, prefix_length(threshold, recall))
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = _low(paths.join(sizes, "path").join(texts.select("node", "sig"), "node"))
    by = ["path", "left", "right"]
    dealt = _blocks(members, "path", "size").repartition(width(texts.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            node, root = _likely(group, threshold - SLACK)
            linked = node != root
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], names=["node", "root"])

    return written(dealt.mapInArrow(run, "node long, root long")).distinct()


def _low(members: DataFrame) -> DataFrame:
    """The signatures' low bytes only: an eighth of a link's traffic is enough to estimate similarity."""
    names = [c for c in members.columns if c != "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), np.uint32).reshape(-1, SIZE)
            low = pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], low], names=[*names, "low"])

    schema = ", ".join(f"{n} {dict(members.dtypes)[n]}" for n in names) + ", low binary"
    return members.select(*names, "sig").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for the nodes in ``links`` (node, root).

    First each node's links lead to its smallest root, and its other roots link to that one: at most two links
    for each node and root stay, however many tries found them. Then each round takes the smallest label among
    neighbours and the label of that label, so chains halve.
    """
    lowest = links.withColumn("low", F.min("root").over(Window.partitionBy("node")))
    star = lowest.select("node", F.col("low").alias("root")).union(lowest.select(F.col("root").alias("node"), F.col("low").alias("root"))).distinct()
    edges = written(star.union(star.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct())
    labels = written(edges.groupBy("node").agg(F.min("root").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "root"), "root").groupBy("node").agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        moved = written(lower.join(jump, lower["label"] == jump["_at"]).select("node", F.least("label", "_to").alias("label"), "_old"))
        labels = moved.select("node", "label")
        if moved.where("label <> _old").isEmpty():
            return labels


def _verified(group: pa.Table, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links among the members of one block pair: node, partners, root."""
    node = group.column("node").to_numpy()
    second = group.column("second").to_numpy(zero_copy_only=False)
    shingle, bounds = _shingles(*arrays.words(group.column("text")), n)
    owner = np.repeat(np.arange(len(node)), np.diff(bounds))
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, bool)
    shingle, owner = shingle[fresh], owner[fresh]
    size = np.bincount(owner, minlength=len(node))
    _, column, uses = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = uses > 1
    place = (np.cumsum(shared) - 1)[column]
    keep = shared[column]
    rows, cols, total = owner[keep], place[keep], int(shared.sum())
    common = np.zeros((len(node), len(node)), np.float32)
    by_col = np.argsort(cols, kind="stable")
    rows, cols = rows[by_col], cols[by_col]
    step = 4096
    for start in range(0, total, step):
        a, b = np.searchsorted(cols, [start, start + step])
        part = np.zeros((len(node), min(step, total - start)), np.float32)
        part[rows[a:b], cols[a:b] - start] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    near = common >= threshold * union - 1e-6
    if second.any():
        near &= second[:, None] != second[None, :]
    links = _Links(len(node))
    for k in range(len(node) - 1):
        links.join(k, k + 1 + np.flatnonzero(near[k, k + 1:]))
    return node, links.partners, links.roots()


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, node), and for each node its label, class_id, n_copies, n_links and first row ``one``."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(sketch(plain, n))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "key", "sig")).alias("one"))
    texts = written(nodes.select("node", "n_copies", "one.void", "one.doc_id", "one.key", "one.sig"))
    links = candidate_links(texts, threshold, recall)
    group = components(links)
    sizes = group.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    wanted = group.join(sizes, "label").join(texts.select("node", "doc_id", "key"), "node")
    keyed = plain.withColumn("key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["key"] == wanted["key"])
    # Repeated rows of one text would multiply its members; one of them goes on.
    chosen = keyed.join(wanted, same).select("label", "size", "node", "text").dropDuplicates(["node"])
    by = ["label", "left", "right"]
    dealt = _blocks(chosen, "label", "size").repartition(width(docs.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, by):
            node, partners, root = _verified(table, n, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(partners), pa.array(node[root])], names=["node", "partners", "root"])

    exact = written(dealt.mapInArrow(run, "node long, partners long, root long"))
    partners = exact.groupBy("node").agg(F.sum("partners").alias("n_links"))
    label = components(exact.where("node <> root").select("node", "root"))
    named = texts.join(label, "node", "left").join(partners, "node", "left").select(
        "node", F.struct("void", "doc_id", "key").alias("one"), "n_copies", F.coalesce("label", "node").alias("label"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = named.groupBy("label").agg(F.min("one").alias("first"))
    return rows, named.join(first, "label").select("node", "label", "first", "n_copies", "n_links")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """The class of every row; see the module's description."""
    rows, nodes = _classes(docs, n, threshold, recall, doc_id, text)
    return rows.select("doc_id", "node").join(nodes, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The first row (smallest doc_id) of every class, with all its columns; rows without words all stay."""
    _, nodes = _classes(docs, n, threshold, recall, doc_id, text)
    stay = nodes.groupBy("label").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn("_own", F.xxhash64(text))
    same = keyed[doc_id].cast("long").eqNullSafe(stay["_id"]) & (keyed["_own"] == stay["_key"])
    kept = keyed.join(stay, same, "left_semi").dropDuplicates([doc_id, "_own"])
    return kept.select(*docs.columns).union(docs.where(~worded))


def query(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text"))
