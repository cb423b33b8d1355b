"""Pages, conversations, urls and toxicity: hand-made cases, brute force and held-out accuracy."""

import random
import re
import time
import zlib

import numpy as np
from llm_checks import same_rows, with_tables
from pyspark.sql import functions as F

from rankloom.llm import html_wrappers, quote_chat, toxicity, url_filter
from rankloom.llm.tables import table

SHELL = """<!DOCTYPE html><html><head><title>No</title><script>var a = "</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div>
<!-- ad --><div class="ad">Buy {n}</div>{main}<aside>Side {n}</aside><form><p>Sign up</p></form>
<section class="comments"><p>Reader {n} says</p></section><footer>&copy; all rights</footer></body></html>"""


def test_article_in_many_shells(spark):
    article = "<article><h1>T&eacute;st {n}</h1><p>One <b>two</b>\n three<br>four<p>Five &amp;amp; six<ul><li>a<li>b</ul><div class='share'>Share</div></article>"
    plain = "<div id='c{n}'><h2>T&eacute;st {n}</h2><p>One <b>two</b>\n three<br>four<p>Five &amp;amp; six<ul><li>a<li>b</ul></div><p>Same on all pages</p>"
    rows = [(k, f"http://one.example/{k}", SHELL.replace("{main}", article).replace("{n}", str(k))) for k in range(4)]
    rows += [(10 + k, f"http://two.example/{k}", SHELL.replace("{main}", plain).replace("{n}", str(k))) for k in range(4)]
    rows += [(20, None, None), (21, "no host", ""), (22, "http://x.example", "<p>cut <b off"), (20, None, None)]
    got = html_wrappers.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for k in [*range(4), *range(10, 14)]:
        assert text[k] == f"Tést {k % 10}\n\nOne two three four\n\nFive &amp; six\n\na\n\nb"
    assert text[20] == text[21] == "" and text[22] == "cut"
    assert html_wrappers.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_class_words_do_not_drop_the_main_text():
    def texts(main):
        pages = [html_wrappers.blocks_of(SHELL.replace("{main}", main).replace("{n}", str(k))) for k in range(4)]
        whole = html_wrappers.wrapper_of(pages[0])
        for blocks in pages[1:]:
            whole = html_wrappers.merged(whole, html_wrappers.wrapper_of(blocks))
        return [html_wrappers.main_text(blocks, *html_wrappers.region_of(whole)) for blocks in pages]

    body = "<p>One text of the page {n}</p><div class='ad-container'>Ad {n}</div><div class='post-share-buttons'>Share {n}</div><div id='cookieBar'>C {n}</div>"
    for name, attributes in [("article", "class='post no-sidebar'"), ("main", "id='search-result'"), ("div", "class='content has-related'"),
                             ("article", "class='widget'"), ("main", "class='form'"), ("div", "class='page-with-comments'")]:
        assert texts(f"<{name} {attributes}>{body}</{name}>") == [f"One text of the page {k}" for k in range(4)], attributes
    assert texts("<div class='widget'><article><p>One text of the page {n}</p></article></div>") == [f"One text of the page {k}" for k in range(4)]
    only = html_wrappers.blocks_of("<body><div class='cookie-notice'>Cookies</div></body>")
    assert html_wrappers.main_text(only, *html_wrappers.region_of(html_wrappers.wrapper_of(only))) == ""


def by_host(pages):
    """Texts of the pages of one host."""
    blocks = [html_wrappers.blocks_of(p) for p in pages]
    whole = html_wrappers.wrapper_of(blocks[0])
    for b in blocks[1:]:
        whole = html_wrappers.merged(whole, html_wrappers.wrapper_of(b))
    known = html_wrappers.region_of(whole) if len(pages) >= html_wrappers.MIN_PAGES else (None, set())
    return [html_wrappers.main_text(b, *known) for b in blocks]


def test_wrapper_decides_between_articles_and_other_elements():
    six, one = range(6), range(1)
    for pages in (six, one):
        teaser = by_host([f"<body><div class=post><p>Main text of page {k}, long enough.</p></div><article>teaser {k}</article></body>" for k in pages])
        assert teaser == [f"Main text of page {k}, long enough." for k in pages]
        cards = by_host([f"<body><main><p>Main text {k}</p><article>card {k}</article><article>card x{k}</article></main></body>" for k in pages])
        assert cards == [f"Main text {k}" for k in pages]
        comments = by_host([f"<body><article><p>Main text {k}</p><article><p>Reader {k} says very, very much about it</p></article></article></body>" for k in pages])
        assert comments == [f"Main text {k}" for k in pages]
    listed = by_host([f"<body><article>part {k} of the text</article><article>second part {k}</article></body>" for k in six])
    assert listed == [f"part {k} of the text\n\nsecond part {k}" for k in six]
    # Classes that differ between pages do not part the region; a layout of its own is read as its own wrapper.
    mixed = by_host([f"<body class='c{'ab'[k % 2]}'><article class='post tag-{'xyz'[k % 3]}'><p>Main text {k}</p></article><p>Site</p></body>" for k in six]
                    + ["<body><div class=other><p>Another layout with its own text</p></div></body>"])
    assert mixed == [*(f"Main text {k}" for k in six), "Another layout with its own text"]


def test_main_text_without_an_article_is_whole():
    def page(k):
        quote = "<blockquote>A quote on one page only</blockquote>" if k == 2 else ""
        return f"<body><p>Site line</p><div class=post><h2>Title {k}</h2><p>Text {k} of this page</p>{quote}</div></body>"
    assert by_host([page(k) for k in range(5)])[2] == "Title 2\n\nText 2 of this page\n\nA quote on one page only"
    assert by_host([page(1)] * 4) == ["Title 1\n\nText 1 of this page"] * 4


def test_many_siblings_fold_in_linear_time():
    def page(n, k):
        return "<body><article>" + "".join(f"<h2>T{i} {k}</h2><p>t{i} {k}</p>" for i in range(n // 2)) + "</article></body>"

    begun = time.perf_counter()
    pages = [page(20_000, k) for k in range(3)]
    assert by_host(pages) == ["\n\n".join(f"T{i} {k}\n\nt{i} {k}" for i in range(10_000)) for k in range(3)]
    draw = random.Random(1)
    odd = ["<body>" + "".join(f"<{n}>x{i} {k}</{n}>" for i, n in enumerate(draw.choices(["h2", "p", "pre", "h3"], k=20_000))) + "</body>" for k in range(3)]
    assert [len(t.split("\n\n")) for t in by_host(odd)] == [20_000] * 3
    assert time.perf_counter() - begun < 30
    whole = html_wrappers.wrapper_of(html_wrappers.blocks_of(page(8, 0)))
    assert html_wrappers.expression(whole) == "#page: body: article: (h2: #TEXT p: #TEXT)+"


def test_both_ways_of_joining_regions_are_equal(spark, data):
    pages = table(spark, data, "pages")
    near, far = (sorted(map(tuple, html_wrappers.extract(pages.withColumn("host", F.lit("clash")), broadcast_bytes=b).collect())) for b in (1 << 30, 0))
    assert near == far


def test_given_pages_give_their_article(spark, data):
    import html

    pages = table(spark, data, "pages")
    text = {r.page_id: r.text for r in html_wrappers.query(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", " ", inner))
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert text[r.page_id] == "\n\n".join(p for p in want if p)


def test_wrapper_is_union_free():
    def page(middle, n):
        return html_wrappers.wrapper_of(html_wrappers.blocks_of(f"<body><h1>Head</h1>{middle}<p>text {n}</p><p>more {n}</p></body>"))

    whole = html_wrappers.merged(page("<div class='x'>note</div>", 1), page("", 2))
    assert html_wrappers.expression(whole) == "#page: body: h1: 'Head' (div.x: 'note')? (p: #TEXT)+"
    assert html_wrappers.merged(whole, page("", 3)) [2][0][2][1][1] == "?"


def test_reply_order(spark):
    rows = [
        (1, 0, "a", "Shall we meet?\nOn Monday perhaps."), (1, 1, "b", "I prefer Tuesday."), (1, 2, "c", "> I prefer  TUESDAY.\nMe too."),
        (1, 3, "a", "> shall we meet?\nNo."), (1, 4, "b", "Why not?"), (1, 5, "c", ">> Shall we meet?\n> No.\nAgreed."),
        (1, 6, "d", "> not in any message\nHm."), (2, 0, "a", None), (2, 1, "b", "> Shall we meet?\nOther conversation"), (2, 1, "b", "> Shall we meet?\nOther conversation"),
        (None, 0, "a", "x"), (None, 1, "a", "> x"), (3, None, None, "> x\ny"),
        (1, 7, "a", "> Agreed.\nGood."), (1, 8, "b", "> No.\nReally?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quote_chat.query(df)
    same_rows(out, with_tables(spark, conversations=df), quote_chat.SQL)
    one = {r.turn: r for r in out.where("conv_id = 1").collect()}
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 3, 6: 5, 7: 5, 8: 3}
    order = sorted(one, key=lambda t: [int(x) for x in one[t].reply_path.split(".")])
    assert order == [0, 3, 5, 6, 7, 8, 4, 1, 2] or order.index(3) < order.index(1)
    assert one[5].formatted == "<|c|>\nAgreed.\n" and out.where("conv_id = 2").count() == 2
    assert quote_chat.query(df.limit(0)).count() == 0


def test_quotes_of_parts_wrapped_and_deeper(spark):
    long = "We could take the early train to the coast. It leaves at seven. The tickets are cheap, and the view from the bridge is fine."
    rows = [
        (1, 0, "a", long), (1, 1, "b", "Something else."), (1, 2, "c", "> It leaves at seven.\nToo early."),
        (2, 0, "a", long), (2, 1, "b", "Something else."), (2, 2, "c", "> the tickets are cheap, and the\n> view from the\n> bridge is fine.\nYes."),
        (3, 0, "a", long), (3, 1, "b", "Something else."), (3, 2, "c", "> an edited line nobody wrote\n>> We could take the early train to the coast.\nYes."),
        (4, 0, "a", long.replace(". ", ".\n")), (4, 1, "b", "Something else."), (4, 2, "c", "> It leaves at seven. The tickets are cheap\nYes."),
        # The shallower level wins although the deeper one matches more.
        (5, 0, "a", long), (5, 1, "b", "Something else."), (5, 2, "c", "Third."), (5, 3, "d", "> Something else.\n>> " + long + "\nYes."),
        (6, 0, "a", ""), (6, 1, "b", ">"), (6, 2, "c", "> \n>> \n" + "word " * 20_000), (6, 3, "d", "> " + "word " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("key", F.lit(1))
    out = quote_chat.query(df)
    same_rows(out, with_tables(spark, conversations=df), quote_chat.SQL)
    answered = {(r.conv_id, r.turn): r.reply_to for r in out.collect()}
    assert [answered[c, 2] for c in (1, 2, 3, 4)] == [0, 0, 0, 0] and answered[5, 3] == 1 and answered[6, 3] == 2


def test_deep_nesting_takes_few_rounds(spark, monkeypatch):
    n, rounds, write = 300, [], quote_chat.written
    monkeypatch.setattr(quote_chat, "written", lambda df: rounds.append(1) or write(df))
    rows = [(1, k, "a", (f"> line number {k - 2} of the talk\n" if k > 1 else "") + f"line number {k} of the talk") for k in range(n)]
    out = {r.turn: r for r in quote_chat.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[k].reply_to == max(k - 2, 0) for k in range(1, n)) and len(rounds) < 16
    paths = {0: [], 1: []} | {}
    for k in range(2, n):
        paths[k] = [*paths[k - 2], k - 2, k]
    assert all([int(x) for x in out[k].reply_path.split(".")] == [*paths[k], k] for k in range(n))


def test_urls_on_hard_rows(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/",
            "a://b://c/d", "http://com", "http://example.com/english", "http://example.com#/en/", "http://example.com?/en/"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "x", "y")], "page_id long, url string, host string, rule string")
    same_rows(url_filter.query(df), with_tables(spark, pages=df.select("page_id", "url")), url_filter.SQL)
    cut = url_filter.filter_urls(df.select("page_id", "url"), url_filter.RULES, max_trie=2).select("page_id", *url_filter.OUTPUT)
    same_rows(cut, with_tables(spark, pages=df.select("page_id", "url")), url_filter.SQL)
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_very_long_segments_take_linear_time():
    trie = url_filter.build_trie([url_filter.Entry("block", "a", "/" + "x" * n) for n in (0, 3, 500)])
    begun = time.perf_counter()
    assert url_filter.lookup(trie, "a", "/" + "x" * 2_000_000) == ("a/" + "x" * 500, "block")
    assert url_filter.lookup(trie, "a", "/" + "y" * 2_000_000) == ("a/", "block")
    assert time.perf_counter() - begun < 1


def test_longest_match_equals_brute_force():
    draw = random.Random(3)
    names = ["a", "b", "a.b", "b.a", "c.a.b"]
    paths = ["/", "/x", "/x/", "/x/y", "/xy/"]
    rules = sorted({url_filter.Entry(draw.choice(["allow", "block"]), draw.choice(names), draw.choice(paths)) for _ in range(12)})
    trie = url_filter.build_trie(rules)
    for host in [*names, "d.c.a.b", "ab"]:
        for path in [*paths, "", "/x/yz", "/xyz"]:
            fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"), default=None)
            assert url_filter.lookup(trie, host, path) == (best and (best.host + best.path, best.verdict))


def test_toxicity_on_held_out_documents(spark, data):
    larger = data.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    got = toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    y, p = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    wins = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    assert wins > 0.95 and (p[y == 0] >= 0.3).mean() < 0.02
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_capped_sample_keeps_the_prior(spark, data):
    larger = data.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").where(toxicity.held_out(F.col("doc_id")))
    p = np.array([r.score for r in toxicity.score(clean, *toxicity.train(docs, labels, 340)).collect()])
    # A sample this small with the true prior gives 0.040 and 0.047, one of equal classes without weights 0.139 and 0.168.
    assert (p >= 0.3).mean() < 0.08 and p.mean() < 0.1
    drawn = toxicity.sample(docs, labels, 200).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("stands_for").alias("all")).collect()
    every = {r.toxic: r.n for r in toxicity.sample(docs, labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert {r.toxic: (r.n, round(r["all"])) for r in drawn} == {t: (200, n) for t, n in every.items()}


def test_offending_sentences_and_hard_rows(spark, hard, nothing):
    docs = spark.createDataFrame([(i, f"Éin guter Satz {i}. " + ("You utter scumbag! " if i % 2 else "") + "Noch ein Satz.") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    weights, bias = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, weights, bias).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for i in range(400):
        assert [text[i][o.start:o.end] for o in out[i].offending] == (["You utter scumbag"] if i % 2 else [])
    odd = toxicity.score(hard, weights, bias).collect()
    assert len(odd) == hard.count() and len({r.score for r in odd if r.n_sentences == 0}) == 1
    assert toxicity.query(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.query(hard, labels.limit(0)).collect()} == {0}
