"""Document operators against brute force, on the given tables and on hard rows."""

import collections
import hashlib
import re

import public_tokenizers
import pyarrow as pa
import pytest
from llm_checks import HARD, same_rows, with_tables
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import bpe, decontaminate, line_dedup, lm_score, ngram_join, quality_rules
from rankloom.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_classes(rows):
    """(doc_id, class_id, n_copies, n_links) by comparing every two texts."""
    texts = collections.defaultdict(list)
    for doc, text in rows:
        words = tuple(WORD.findall(text or ""))
        if words:
            texts[words].append(doc)
    sets = {w: shingles(w) for w in texts}
    links, root = collections.Counter(), {w: w for w in texts}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    keys = list(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for w, docs in texts.items():
        ids[find(w)] += [d for d in docs if d is not None]
    out = []
    for doc, text in rows:
        w = tuple(WORD.findall(text or ""))
        out.append((doc, min(ids[find(w)], default=None), len(texts[w]), links[w]) if w else (doc, doc, 1, 0))
    return sorted(out, key=repr)


def near(text, places):
    words = text.split()
    for p in places:
        words[p] = f"changed{p}"
    return " ".join(words)


def test_join_equals_all_pairs(spark, data):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    base = " ".join(f"token{i}" for i in range(300))
    rows += [(10_000 + k, near(base, [k % 290])) for k in range(290)] + [(20_000, base)] + [(30_000 + k, base) for k in range(50)]
    rows += [(40_000 + k, near(base, range(k, 300, 5))) for k in range(3)] + [(r[0], r[1]) for r in HARD]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows)


def test_a_large_group_hides_no_borderline_pairs(spark):
    base = " ".join(f"token{i}" for i in range(300))
    rows = [(10_000 + k, near(base, [5 + k])) for k in range(290)]
    for k in range(400):  # each pair shares 170 of 210 shingles or, every other one, 186 of 226
        words = " ".join(f"p{k}x{i}" for i in range(194 + 16 * (k % 2)))
        rows += [(20_000 + 2 * k, words), (20_001 + 2 * k, near(words, (20, 60, 100, 140)))]
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[10_000 + k].n_links for k in range(290)} == {289}
    lost = [k for k in range(400) if any(got[20_000 + 2 * k + i].n_links != 1 or got[20_000 + 2 * k + i].class_id != 20_000 + 2 * k for i in (0, 1))]
    assert lost == []


def test_one_of_each_class_stays(spark, hard, nothing):
    kept = ngram_join.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, None, 7, 8, 9, 11, 12], key=repr)
    assert ngram_join.join(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def brute_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, data, hard):
    for docs in (table(spark, data, "documents"), hard):
        got = [tuple(r) for r in quality_rules.with_stats(docs).select("doc_id", *quality_rules.STATS[:5]).collect()]
        want = [(r.doc_id, *brute_stats(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rules_are_learned_and_keep_good_rows(spark, data, hard, nothing):
    larger = data.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    judged = quality_rules.query(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert sum(not r.kept for r in judged if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in judged)
    assert quality_rules.query(nothing, labels).count() == 0
    none = labels.limit(0)
    assert {r.kept for r in quality_rules.query(hard, none).collect() if r.doc_id not in (9, 10)} == {False}
    assert sorted(r.doc_id for r in quality_rules.keep_good(hard, none).collect()) == [9, 10]


def test_rules_take_ordered_conjunctions(spark):
    """Bad rows need two terms: many capitals and short words."""
    rows = [(i, 100, 400 if i % 2 else 900, 0, 0, 0, 90 if i % 4 < 2 else 0, 5) for i in range(400)]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                        "n_repeat_words long, n_caps long, n_lines long")
    labels = stats.select("doc_id", F.when((F.col("word_chars") == 400) & (F.col("n_caps") == 90), 0).otherwise(1).alias("quality"))
    rules = quality_rules.learn_rules(stats, labels)
    assert len(rules) == 1 and {t.feature for t in rules[0]} == {"caps_share", "word_length"}
    wrong = quality_rules.with_verdict(stats, rules).join(labels, "doc_id").where("kept <> (quality = 1)")
    assert wrong.count() == 0


def test_line_dedup_on_hard_rows(spark, hard, nothing):
    con = with_tables(spark, documents=hard.select("doc_id", "text", "source"))
    same_rows(line_dedup.query(hard), con, line_dedup.SQL)
    out = line_dedup.drop_boilerplate(hard, ratio=0.3, min_pages=2)
    assert {r.text for r in out.where("doc_id = 11").collect()} == {"\nother"}
    assert line_dedup.drop_boilerplate(nothing).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    rows = [(k, "copied line\nand another", "a") for k in range(30)] + [(100 + k, f"menu line \npage {k}", "a") for k in range(6)]
    rows += [(200 + k, f"page of its own {k}", "a") for k in range(80)] + [(300 + k, None, None) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got == {k: text if not 100 <= k < 200 else f"page {k - 100}" for k, text, _ in rows}
    same_rows(line_dedup.query(docs), with_tables(spark, documents=docs), line_dedup.SQL)


def test_lm_score_on_hard_rows(spark, hard, nothing):
    same_rows(lm_score.query(hard), with_tables(spark, documents=hard.select("doc_id", "text")), lm_score.SQL)
    assert lm_score.query(nothing).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, data, hard, nothing, tokenizer):
    for docs in (table(spark, data, "documents").select("doc_id", "text"), hard):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.query(docs).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.query(nothing).count() == 0


def test_bpe_equals_the_library_on_all_code_points(spark, tokenizer):
    import random

    draw = random.Random(2)
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[k:k + 50]) for k in range(0, len(points), 50)] + [" ".join(f"a{c}b {c}" for c in points[k:k + 50]) for k in range(0, len(points), 50)]
    texts += ["".join(draw.choices(draw.choice([points, points[:0x600], "aA Σσ.'\u0301\u00a0\x1c\n3"]), k=30)) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.query(rows).collect()}
    assert [k for k, ids in enumerate(want) if got[k] != (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] == []


def brute_tiles(doc, item, least):
    """Greedy string tiling by comparing all places."""
    doc_used, item_used, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in doc_used and q + n not in item_used:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((p, q, n))
        doc_used |= set(range(p, p + n))
        item_used |= set(range(q, q + n))


def test_reordered_passage_is_found(spark, hard, nothing):
    item = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    parts = item.split(". ")
    docs = spark.createDataFrame([
        (1, "before " + item + " after"), (2, f"x {parts[2]} y {parts[0].upper()} z {parts[1]}"), (3, "before " + parts[0] + " after"),
        (4, None), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "a b"), (11, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 7), (0, 8), (1, 7), (1, 8), (2, 7), (2, 8)]
    assert {(r.doc_id, r.n_tiles, r.reordered) for r in got} == {(1, 1, False), (2, 3, True), (None, 1, False)}
    blocks = decontaminate.contaminated(docs, bench, block_tokens=10).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontaminate.clean(hard, bench).count() == len(HARD) and decontaminate.query(nothing, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 6


def brute_contaminated(docs, bench):
    """(doc_id, item_id, coverage) by comparing all places."""
    word = re.compile(r"[a-z0-9]+")
    out = []
    for doc, text in docs:
        for item, whole in bench:
            a, b = word.findall((text or "").lower()), word.findall((whole or "").lower())
            covered = sum(n for *_, n in brute_tiles(a, b, min(5, len(b)))) if b else 0
            if b and covered / len(b) >= 0.5 - 1e-12:
                out.append((doc, item, round(covered / len(b), 9)))
    return sorted(out)


def test_contaminated_equals_brute_force_with_short_items(spark):
    import random

    draw = random.Random(8)
    names = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(draw.choices(names, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 20, 31, 40, 40])]
    bench += [(50, "Only four tokens here"), (51, "two tokens"), (52, None), (53, "-- !")]
    docs = [(0, "say only four tokens here. Two tokens"), (1, "only four tokens, there"), (2, None)]
    for k in range(60):
        words = draw.choices(names, k=60)
        for _, whole in draw.sample(bench[:12], 3):
            cut = whole.split()
            cut = cut[draw.randrange(3):] if len(cut) > 5 else cut
            at = draw.randrange(len(words))
            half = len(cut) // 2
            words[at:at] = draw.choice([cut, cut, cut[half:] + ["x"] + cut[:half], cut[:half]])
        docs.append((10 + k, " ".join(words)))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    want = brute_contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id, round(r.coverage, 9)) for r in got) == want and {(0, 50, 1.0), (0, 51, 1.0)} <= set(want)
    assert {r[1] for r in want} >= {0, 1, 2, 3}


def test_tiling_equals_brute_force():
    import random

    draw = random.Random(4)
    for _ in range(60):
        item = [draw.choice("abcdef") for _ in range(24)]
        doc = [draw.choice("abcdef") for _ in range(10)] + item[12:] + [draw.choice("abcdef") for _ in range(4)] + item[:12]
        block = decontaminate.Items([(1, " ".join(item))], 3)
        want = brute_tiles(doc, item, 3)
        got = block.matches(pa.array([" ".join(doc)]), 0.0)
        assert got[0][0]["coverage"] * len(item) == pytest.approx(sum(n for *_, n in want), abs=3)
        assert got[0][0]["coverage"] >= 0.95
