from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.operators import chunking


def windows(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.w for r in df.select("i", chunking.window_text(F.col("t"), size, overlap).alias("w")).orderBy("i").collect()]


def test_hard_cut_keeps_the_redundant_slice(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    assert windows(spark, [text], 1400, 200) == [[text[:1400], text[1200:2500], text[2400:]]]


def test_short_and_empty(spark):
    assert windows(spark, ["", "abc", "x" * 1400], 1400, 200) == [[], ["abc"], ["x" * 1400]]


def test_paragraph_packing(spark):
    a, b, c = "a" * 30, "b" * 30, "c" * 10
    assert windows(spark, [f"{a}\n\n{b}\n\n{c}"], 60, 8) == [[a, f"{'a' * 8}\n\n{b}\n\n{c}"]]
    # the tail is used only when shorter than the next paragraph
    assert windows(spark, [f"{a}\n\n{b}\n\n{c}"], 40, 10) == [[a, f"{'a' * 10}\n\n{b}", c]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab \n", max_size=120), min_size=20, max_size=40))
def test_window_bounds(spark, texts):
    for text, ws in zip(texts, windows(spark, texts, 40, 10)):
        assert all(0 < len(w) <= 40 + 10 + 2 for w in ws)
        if len(text) <= 40:
            assert ws == ([text] if text else [])
        else:
            assert set("".join(ws)) >= set(text) - set(" \n")


def test_markdown_sections_and_merging(spark):
    long = "w " * 80
    raw = f"intro\n# A\n{long}\n## B\nshort\n### C\n{long}\n## D\n{long}\n# E\nlast"
    df = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    got = chunking.markdown_chunks(df, Config()).orderBy("ordinal").collect()
    assert [(r.heading, r.heading_path) for r in got] == [("A", "A"), ("B", "A > B"), ("D", "A > D"), ("E", "E")]
    assert [r.ordinal for r in got] == [0, 1, 2, 3]
    # the text above the first heading is short, has no heading of its own, and opens the next chunk
    assert got[0].body.startswith("intro")
    # a short section keeps its heading and swallows the next one's as text
    assert "## C" in got[1].body and got[3].body == "last"


def test_line_windows(spark):
    text = "\n".join(str(i) for i in range(1, 6)) + "\n"
    df = spark.createDataFrame([(1, text), (2, "\n\n\n"), (3, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_line, r.end_line, r.body) for r in chunking.line_windows(df, 2).collect())
    assert got == [(1, 1, 2, "1\n2"), (1, 3, 4, "3\n4"), (1, 5, 5, "5"), (3, 1, 1, "x")]
