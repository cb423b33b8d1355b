"""Filter audit, ranked search and quartile digests: against SQL, brute force and hand cases."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_checks import HARD, LONG, same_rows, with_tables
from pyspark.sql import functions as F

from rankloom.llm import bloom_search, filter_audit, quartile_digest
from rankloom.llm.tables import table, written

LABELS = "doc_id long, quality int, toxic int, n long"
TAGS = [(1, 1, 0, 1), (2, 0, 1, 1), (2, 1, None, 1), (3, None, None, 1), (None, 1, 1, 1), (9, 1, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(TAGS, LABELS)


# ------------------------------------------------------------------ filter audit


def brute_audit(rows, tags):
    """Every order applied to every row, one by one."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good = {d for d, q, _, _ in tags if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in tags if t == 1 and d is not None}
    fails = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and first[text] < doc}
        fails.append((doc, part or "", {c for c, x in mask.items() if x}))
    out, shapley = {}, collections.Counter()
    parts = sorted({p for _, p, _ in fails})
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in parts:
            left = [(d, f) for d, p, f in fails if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                out[part, order, step] = [len(left), len(removed), sum(letter in f for _, f in gone),
                                          sum(p == part and f == {letter} for _, p, f in fails), sum(d in good for d, _ in removed),
                                          sum(d in toxic for d, _ in removed)]
                shapley[part, letter] += len(removed)
                gone += removed
    return sorted([*k, *v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items())


def test_audit_equals_applying_every_order(spark, hard, labels):
    want = brute_audit([(r.doc_id, r.text, r.source) for r in hard.collect()], TAGS)
    got = filter_audit.query(hard.withColumn("mask", F.lit("x")).withColumn("part", F.lit("y")), labels)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(list(r) for r in got.collect()) == want


def test_audit_of_hard_rows_equals_sql(spark, hard, labels):
    same_rows(filter_audit.query(hard, labels), with_tables(spark, documents=hard, labels=labels), filter_audit.SQL)


def test_audit_of_nothing(spark, nothing, labels):
    assert filter_audit.query(nothing, labels).count() == 0


def test_audit_without_labels(spark, hard, labels):
    rows = filter_audit.query(hard, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert rows[0] == rows[1] == 0 and rows[2] == 600 * len({s or "" for *_, s in HARD})


def test_shares_add_up_to_removed(spark, data):
    rows = filter_audit.query(table(spark, data, "documents"), table(spark, data, "labels"))
    each = rows.groupBy("part", "filter_order").agg(F.sum("removed").alias("removed"), F.min("kept").alias("kept"), F.sum("shapley").alias("shares"))
    assert each.where("shares <> 120 * removed").count() == 0
    assert each.select("part", F.col("removed") + F.col("kept")).distinct().count() == each.select("part").distinct().count()


def test_copies_of_one_text_meet_on_their_ids(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'same text' as text", "'s' as source")
    plan = filter_audit.failures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
    assert filter_audit.failures(docs).where("mask >= 16").count() == 999


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, k=50):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counted = [(d, collections.Counter(find(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, words = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(find(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "Footer line HERE"), (1, "beta"), (2, None), (3, "..."), (None, "the один Σ"), (5, "absent words only"), (6, "w5x5 w6x6 one the alpha")]


def searched(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_of_hard_rows(spark, hard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = bloom_search.query(hard.withColumn("terms", F.lit(1)), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert searched(got) == brute_search([(r[0], r[1]) for r in HARD], ITEMS)


def test_search_of_the_given_tables(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    index = written(bloom_search.index(table(spark, data, "documents").repartition(3)))
    for k in (1, 7, 50):
        assert searched(bloom_search.search(index, table(spark, data, "benchmark"), k)) == brute_search(docs, items, k)


def test_search_in_many_blocks(spark, data, monkeypatch):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    want = searched(bloom_search.query(docs, items))
    monkeypatch.setattr(bloom_search, "BLOCK_PAIRS", 200)
    assert searched(bloom_search.query(docs, items)) == want


def test_bounds_are_never_below_scores(spark, data):
    """Signatures far too narrow still give true bounds, and wide ones leave most documents out."""
    docs = [(r.doc_id, r.text or "") for r in table(spark, data, "documents").collect()]
    rows = next(iter(pa.Table.from_pydict({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.large_string())}).to_batches()))
    held = list(bloom_search._documents(rows))
    total = sum(d.size for d in held)
    pairs = pa.Table.from_pylist([{"item_id": i, "term": t} for i, text in enumerate(docs[5][1][:3000].split("\n")[:3]) for t in
                                  sorted({x.decode() for x in bloom_search.TERM.findall(text.lower().encode())})] or [{"item_id": 0, "term": "the"}])
    asked = bloom_search._asked(pairs, len(held), total)
    asked = bloom_search.replace(asked, weights=np.full(len(asked.terms), 1000))
    exact = bloom_search._Exact(asked)
    exact = np.array([exact.scores(d.text, d.size, range(len(asked.items))) for d in held]).T
    loose = {}
    for rows_ in (64, 1 << 14):
        block = bloom_search._packed(1, rows_, held)
        bounds = bloom_search._bounds(asked, np.array(block["sizes"]), rows_, block["slices"])
        assert (bounds >= exact).all()
        loose[rows_] = int((bounds - exact).sum())
    assert loose[1 << 14] < loose[64]


def test_search_of_nothing(spark, hard, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bloom_search.query(nothing, items).count() == 0
    assert bloom_search.query(hard, items.where("false")).count() == 0


def test_equal_scores_rank_by_id(spark):
    docs = spark.range(200).selectExpr("199 - id as doc_id", "'same words here' as text").unionByName(
        spark.range(300).selectExpr("1000 + id as doc_id", "'other things there' as text"))
    got = bloom_search.query(docs, spark.createDataFrame([(1, "words")], "item_id long, text string")).sort("rank").collect()
    assert [r.doc_id for r in got] == list(range(50)) and [r["rank"] for r in got] == list(range(1, 51))


# --------------------------------------------------------------------- digests


def slow_digest(text):
    """The digest of one text, counter by counter."""
    data = (text or "").encode()
    counts = [0] * quartile_digest.BUCKETS
    for p in range(len(data)):
        for (i, j), tables in zip(quartile_digest.TRIPLES, quartile_digest._TABLES, strict=True):
            if p + j < len(data):
                counts[tables[0][data[p]] ^ tables[1][data[p + i]] ^ tables[2][data[p + j]]] += 1
    ordered = sorted(counts)
    cuts = [ordered[len(ordered) * q // 4 - 1] for q in (1, 2, 3)]
    size = min(255, math.floor(math.log1p(len(data)) / math.log(quartile_digest.LENGTH_BASE)))
    return [size, cuts[0] * 15 // max(1, cuts[2]), cuts[1] * 15 // max(1, cuts[2]), *[sum(c > q for q in cuts) for c in counts]]


def slow_text(digest):
    bits = "".join(f"{c:02b}" for c in digest[3:])
    return f"{digest[0]:02x}{digest[1]:x}{digest[2]:x}" + "".join(f"{int(bits[i:i + 8], 2):02x}" for i in range(0, len(bits), 8))


def slow_likeness(a, b):
    total = sum(4 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[3:], b[3:], strict=True))
    total += min(24, abs(a[0] - b[0])) + sum(min(8, abs(x - y)) for x, y in zip(a[1:3], b[1:3], strict=True))
    return 1 - total / quartile_digest.LARGEST


def brute_neighbours(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text)
        changed = text[:n - n // 3] + after[:n // 3]
        a, b, c = slow_digest(text), slow_digest(changed), slow_digest(after)
        out.append((doc, n, hashlib.sha256(changed.encode()).hexdigest(), slow_text(a), slow_text(b), slow_likeness(a, b), slow_likeness(a, c)))
    return sorted(out)


def test_digests_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "a", "ab", "abc", "abcd", "abcde", "один два", "漢字" * 30, "the quick brown fox " * 9,
                                          "The quick brown fox " * 9, "same", "same", "x" * 5000, " ".join(f"w{i}" for i in range(400))])]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "'x' as part", "1 as n_chars", "2 as following")
        assert sorted(map(tuple, quartile_digest.query(docs).collect())) == brute_neighbours(rows)


def test_neighbours_of_the_given_documents(spark, data):
    docs = table(spark, data, "documents")
    got = {r.doc_id: r for r in quartile_digest.query(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        n, after = len(text) // 3, rows[(i + 1) % len(rows)][1]
        assert got[doc].edited_sha256 == hashlib.sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()
    assert {r.doc_id: r.fingerprint for r in quartile_digest.fingerprints(docs).collect()} == {d: r.fingerprint for d, r in got.items()}
    likelier = sum(r.near_edited > r.near_next for r in got.values())
    assert likelier > 0.95 * len(got) and all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))


def test_digests_of_hard_rows(spark, hard, nothing):
    got = quartile_digest.query(hard).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in HARD)
    by_text = {r[0]: r[1] for r in HARD}
    prints = {}
    for r in got:
        assert prints.setdefault(by_text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert next(r.n_chars for r in got if r.doc_id == 9) == len(LONG)
    assert quartile_digest.query(nothing).count() == 0
    one = quartile_digest.query(hard.where("doc_id = 11")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_chars == 23
