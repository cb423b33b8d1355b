"""The pipeline's stages one by one and as a whole against brute force over planted rows."""

import collections
import hashlib
import random

from llm_checks import HARD
from test_text_operators import WORD, brute_classes, brute_contaminated, brute_stats, near, tokenizer  # noqa: F401

import corpus_pipeline
from rankloom.llm.tables import table


def planted():
    draw = random.Random(12)
    names = [f"word{i}" for i in range(3000)]

    def page(n=120):
        return "\n".join(" ".join(draw.choices(names, k=30)) for _ in range(n // 30))

    rows = [(k, page(), "en", "site" + "ab"[k % 2]) for k in range(40)]
    rows += [(100 + k, "Menu line of the site\n" + page(), "en", "sitec") for k in range(8)]
    rows += [(200, rows[3][1], "en", "sitea"), (201, near(rows[4][1], [50]).replace(" ", "\n", 1), "en", "siteb"), (202, near(rows[5][1], range(0, 120, 4)), "en", "sitea")]
    rows += [(300, "too short to keep", "en", "sitea"), (301, "same three words " * 40, "en", "sitea")]
    bench = [(1, " ".join(draw.choices(names, k=20))), (2, " ".join(draw.choices(names, k=14))), (3, None), (4, "never standing anywhere")]
    first, second = (b[1].split() for b in bench[:2])
    rows += [(400, page() + " " + bench[0][1].upper(), "en", "sitea"), (401, " ".join([page(), *second[7:], "x", *second[:7]]), "en", None),
             (402, " ".join([page(), *first[:8]]), "en", "siteb")]
    rows += [(r[0] and r[0] + 1000, r[1], r[2], r[3]) for r in HARD] + [rows[0]]
    return rows, bench


def without_boilerplate(rows):
    pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, _, source in rows:
        pages[source].add(text)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[source, line.strip(" \t\n\v\f\r")].add(text)
    gone = {k for k, v in seen.items() if len(v) >= 3 and len(v) > 0.05 * len(pages[k[0]])}
    return [(i, text and "\n".join(x for x in text.split("\n") if (source, x.strip(" \t\n\v\f\r")) not in gone), lang, source) for i, text, lang, source in rows]


def test_stages_and_run_equal_brute_force(spark, tmp_path, tokenizer):  # noqa: F811
    rows, bench = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "cast(length(text) as bigint) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def good(text):
        n, _, _, _, repeats = brute_stats(text)
        return n >= 50 and 100 * repeats <= 50 * n

    wants = [[r for r in rows if good(r[1])]]
    wants.append(without_boilerplate(wants[0]))
    classes = dict((c[0], c[1]) for c in brute_classes([r[:2] for r in wants[1]]))
    wants.append(sorted({r for r in wants[1] if classes[r[0]] == r[0]}))
    leaked = {doc for doc, _, _ in brute_contaminated([r[:2] for r in wants[2]], bench)}
    wants.append([r for r in wants[2] if r[0] not in leaked])
    assert leaked == {400, 401} and [len(w) for w in wants[:3]] == [57, 57, 53]
    docs = table(spark, str(tmp_path), "documents")
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants, strict=False):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        got = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
        assert got == sorted(want, key=lambda r: r[:2]), name
    ids = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids for r in wants[3]}
    want = {k: (len(v), hashlib.sha256(" ".join(map(str, v)).encode()).hexdigest()) for k, v in ids.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in whole} == want and len(whole) == len(want)


def test_empty_tables(spark, tmp_path):
    for name, schema in [("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"),
                         ("labels", "doc_id long, quality int, toxic int")]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
