"""Lexical scoring of many questions at once over any collection of text units.

All rankings rest on a stored inverted index (``operators.postings``): the texts are read, cut and tokenised once and
never shuffled; a search reads the postings of the questions' terms. The term side carries no blind broadcast hint: it is
broadcast while its counted size allows, and is otherwise shuffled with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.stemming import stem_table
from rankloom.functions.text import code_tokens, or_query, words
from rankloom.operators import postings
from rankloom.operators.postings import Index
from rankloom.session import broadcast_checked, stored


def query_terms(questions: DataFrame, tokens=code_tokens) -> DataFrame:
    """``questions(query_id, question)`` to the set of (query_id, term)."""
    return questions.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")
    )


def best_k(scored: DataFrame, k: int, key: str = "chunk_id", group: str = "query_id") -> DataFrame:
    """Rank by score, then id, inside each question; keep ``k``."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


ANCHOR_CHARS = 4


# ------------------------------------------------------------------------- BM25


def bm25_index(units: DataFrame, text: Column) -> Index:
    return postings.build(units, code_tokens(text))


def collection_stats(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df, len_sum) of the question terms; the empty term carries the totals of the collection."""
    whole = index.blocks.agg(F.lit("").alias("term"), F.coalesce(F.sum("n"), F.lit(0)).alias("df"), F.coalesce(F.sum("total"), F.lit(0)).alias("len_sum"))
    return postings.frequencies(index, terms).join(postings.lengths(index, terms), "term").unionByName(whole)


def _bm25_terms(index: Index, questions: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, postings.Part]:
    """Question terms, their weights, and the damped term count of Okapi BM25."""
    n, mean = index.totals()
    terms = query_terms(questions)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(postings.frequencies(index, terms), "term").select("query_id", "term", idf.alias("weight"))

    def part(tf, length):
        return tf * (cfg.bm25_k1 + 1) / (tf + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * length / (mean or 1.0)))

    return terms, weights, part


def bm25(units: DataFrame, questions: DataFrame, text: Column, cfg: Config = DEFAULTS) -> DataFrame:
    """Okapi BM25 of every question against every unit that shares a term with it."""
    index = bm25_index(units, text)
    terms, weights, part = _bm25_terms(index, questions, cfg)
    return postings.score(index, broadcast_checked(weights, terms), part).withColumn("score", F.round("score", 9))


def bm25_topk(units: DataFrame, questions: DataFrame, text: Column, k: int, cfg: Config = DEFAULTS) -> DataFrame:
    index = bm25_index(units, text)
    terms, weights, part = _bm25_terms(index, questions, cfg)
    return best_k(postings.best(index, weights, part, k).withColumn("score", F.round("score", 9)), k)


# --------------------------------------------------------------- weighted match


def weighted_index(units: DataFrame, head: Column, body: Column, tokens=words, cfg: Config = DEFAULTS) -> Index:
    """Index whose marks are the summed position weights of a word, in whole tenths to stay exact."""
    tenths = lambda w: int(round(w * 10))
    cut = units.select("chunk_id", tokens(head).alias("_h"), tokens(body).alias("_b"))
    marks = F.concat(F.array_repeat(F.lit(tenths(cfg.weight_head)), F.size("_h")), F.array_repeat(F.lit(tenths(cfg.weight_body)), F.size("_b")))
    return postings.build(cut, F.concat("_h", "_b"), marks)


def _or_terms(questions: DataFrame, tokens) -> DataFrame:
    asked = questions.select("query_id", or_query(F.col("question")).alias("question"))
    return query_terms(asked, lambda q: F.filter(tokens(q), lambda t: t != "or"))


def _whole(mark, length):
    return mark * 1


def weighted_match(units: DataFrame, questions: DataFrame, head: Column, body: Column,
                   tokens=words, cfg: Config = DEFAULTS) -> DataFrame:
    """OR match with position weights: every matched word in the head counts ``weight_head``,
    in the body ``weight_body``.

    For a pure OR query each matched position is its own cover, so the cover-density score is
    the sum of the position weights.
    """
    terms = _or_terms(questions, tokens).withColumn("weight", F.lit(1))
    index = weighted_index(units, head, body, tokens, cfg)
    return postings.score(index, broadcast_checked(terms, terms), _whole).withColumn("score", F.col("score") / 10.0)


def weighted_topk(units: DataFrame, questions: DataFrame, head: Column, body: Column, k: int,
                  tokens=words, cfg: Config = DEFAULTS) -> DataFrame:
    """The ``k`` best units of each question by ``weighted_match``."""
    terms = _or_terms(questions, tokens).withColumn("weight", F.lit(1))
    index = weighted_index(units, head, body, tokens, cfg)
    return best_k(postings.best(index, terms, _whole, k).withColumn("score", F.col("score") / 10.0), k)


def stemmed_topk(units: DataFrame, questions: DataFrame, head: Column, body: Column, k: int, cfg: Config = DEFAULTS) -> DataFrame:
    """``weighted_topk`` over Finnish stems without stop words.

    The index holds plain words; only its distinct words are stemmed, once each, and a question asks for every word with
    one of its stems. Marks of words with the same stem add up, so the scores are those of an index of stems.
    """
    index = weighted_index(units, head, body, words, cfg)
    known = stem_table(index.postings.select("term").distinct())
    asked = _or_terms(questions, words)
    own = stem_table(asked.select("term").distinct())
    stems = asked.join(own, "term").select("query_id", "stem").distinct()
    terms = (stems.join(known, "stem").select("query_id", "term", F.lit(1).alias("weight")))
    return best_k(postings.best(index, terms, _whole, k).withColumn("score", F.col("score") / 10.0), k)


def match_counts(units: DataFrame, questions: DataFrame, body: Column) -> DataFrame:
    """How many units match any term of each question (the bare OR predicate)."""
    index = postings.build(units, words(body))
    terms = query_terms(questions, words)
    pairs = postings.matches(index, broadcast_checked(terms, terms)).groupBy("query_id", F.col("p.chunk_ids").alias("chunk_id")).agg(F.count("*").alias("terms"))
    counts = pairs.groupBy("query_id").agg(
        F.count("*").alias("matched_units"), F.max("terms").alias("most_terms")
    )
    return questions.select("query_id").join(counts, "query_id", "left").select(
        "query_id",
        F.coalesce("matched_units", F.lit(0)).alias("matched_units"),
        F.coalesce("most_terms", F.lit(0)).alias("most_terms"),
    )


def _runs(letters: str, n: int) -> Column:
    """Every n neighbouring characters; shorter ones at the end match no anchor."""
    return F.transform(letters, lambda x, i: F.array_join(F.slice(letters, i + 1, F.lit(n)), ""))


def verbatim_gold(units: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the unit text holds the whole question text.

    Inner words of a contained question are whole words of the text around it, so both sides
    meet on one pair of neighbouring inner words, the longest of the question (an equi-join),
    and the text check runs on those pairs only. Questions with a single inner word meet on
    that word. A question without an inner word, in any script, meets on its first characters
    (at most ``ANCHOR_CHARS``). Only the empty question has no gold.
    """
    units = units.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def neighbours(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    def longest(keys):
        return F.array_max(F.transform(keys, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]

    tokens = questions.select("query_id", "question", code_tokens(F.col("question")).alias("t"))
    q = tokens.where(F.size("t") >= 3)
    inner = q.select("query_id", F.slice("t", F.lit(2), F.size("t") - 2).alias("t"))
    several = inner.where(F.size("t") >= 2).select("query_id", longest(neighbours(F.col("t"))).alias("key"))
    single = inner.where(F.size("t") == 1).select("query_id", F.get("t", F.lit(0)).alias("key"))
    toks = units.select("doc_id", code_tokens(F.col("text")).alias("t"))

    def meet(keys, anchors):
        return toks.select("doc_id", F.explode_outer(F.array_distinct(keys)).alias("key")).join(anchors, "key")

    maybe = meet(neighbours(F.col("t")), several)
    if not single.isEmpty():
        maybe = maybe.unionByName(meet(F.col("t"), single))
    brief = tokens.where((F.size("t") < 3) & (F.length("question") > 0)).select("query_id", F.split("question", "").alias("c"))
    sized = brief.select("query_id", "c", F.least(F.size("c"), F.lit(ANCHOR_CHARS)).alias("n"))
    for n in sorted(r.n for r in sized.select("n").distinct().collect()):  # at most ANCHOR_CHARS values
        anchors = sized.where(F.col("n") == n).select("query_id", F.array_join(F.slice("c", 1, n), "").alias("key"))
        letters = units.select("doc_id", F.split("text", "").alias("c")).where(F.size("c") >= n)
        grams = letters.select("doc_id", F.explode(F.array_distinct(_runs("c", n))).alias("key"))
        maybe = maybe.unionByName(grams.join(anchors, "key").select("key", "doc_id", "query_id"))
    # The pairs are stored, so that their size decides how they meet the texts again, in the scan if they are few.
    return (
        stored(maybe.select("query_id", "doc_id"))
        .join(questions.select("query_id", "question"), "query_id")
        .join(units, "doc_id")
        .where(F.contains("text", "question"))
        .select("query_id", "doc_id")
    )
