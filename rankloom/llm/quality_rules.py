"""Quality rules: an ordered decision list learned by sequential covering, applied as Spark conditions.

Statistics of a text come from array expressions on its own row; nothing is shuffled. Learning looks for
conjunctions of thresholds that hold for bad rows and not for good ones: each rule grows by the term with the
largest information gain, is pruned on rows held out for that, and the rows that it covers leave before the
next rule. Every step is one Spark aggregate over binned statistics of all labelled rows; the driver only sees
counts for each feature and bin.

Words are runs of characters other than space and ``\\t`` to ``\\r``. Defined results: a null text counts as
empty and fails the base rules; without labels of both kinds the list is empty and the base rules decide; a
label row without text, or with a null label, is not used; of repeated labels of a document the lowest counts;
repeated documents are judged each; extra columns pass through unless they bear an output name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps", "n_lines")
FEW = 12
FEATURES = {
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "caps_share": lambda: F.col("n_caps") / F.greatest("n_words", F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "words": lambda: F.col("n_words").cast("double"),
}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return FEATURES[self.feature]() > F.lit(self.cut) if self.above else FEATURES[self.feature]() <= F.lit(self.cut)


Rule = tuple[Term, ...]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns STATS (long), by row-local expressions."""
    plain = docs.drop(*STATS)
    body = F.coalesce(F.col(text), F.lit(""))
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\n\v\f\r", body)
    split = plain.select(
        "*", F.array_remove(F.split(spaced, " "), "").alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    # Hash of each window of three words; only texts with a repeated hash are looked at more closely.
    hashed = split.select("*", F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda w, i: F.xxhash64(
        w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.size("_w") - 2)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    sorted_ = hashed.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")).alias("_s"))
    again = sorted_.select("*", F.array_distinct(F.filter("_s", lambda h, i: h == F.get("_s", i - 1))).alias("_d"))
    # Places of repeated windows: looked up for a few repeated hashes, else found by sorting (hash, place).
    pairs = again.select("*", F.when(F.size("_d") > FEW, F.sort_array(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_q"))
    looked_up = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    beside = F.sort_array(F.transform(F.filter("_q", lambda x, i: (
        F.coalesce(F.get("_q", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_q", i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))
    same = pairs.select("*", F.when(F.size("_d") > FEW, beside).when(F.size("_d") > 0, looked_up).alias("_p"))
    # A window covers three words, or those up to the next repeated window.
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return same.select(
        *plain.columns, F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"), "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda n, k: n + k), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_caps"),
        F.size("_l").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rules: int = 8,
                max_terms: int = 3, bins: int = 24, min_precision: float = 0.95, min_cover: int = 3) -> list[Rule]:
    """Ordered rules for rows labelled 0 among those that pass the base rules."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    rows = stats.where(~base_failed()).select(F.col(key).alias("_key"), *[f().alias(n) for n, f in FEATURES.items()])
    rows = written(rows.join(marks, "_key").select(
        *FEATURES, (F.col("_label") == 0).alias("bad"), (F.pmod(F.xxhash64("_key"), F.lit(3)) == 0).alias("held")))
    grow, held = rows.where("not held"), rows.where("held")
    shares = [i / bins for i in range(bins)]
    cuts = grow.groupBy("bad").agg(*[F.percentile_approx(n, shares, 1000).alias(n) for n in FEATURES]).collect()
    if len(cuts) < 2:
        return []
    edges = {n: sorted({x for r in cuts for x in r[n]}) for n in FEATURES}

    def covered(rule: Rule) -> Column:
        return reduce(lambda a, t: a & ((F.col(t.feature) > t.cut) if t.above else (F.col(t.feature) <= t.cut)), rule, F.lit(True))

    binned = written(grow.select("bad", *FEATURES, F.array(*[
        F.struct(F.lit(n).alias("f"), _bin(n, edges[n]).alias("b"))
        for n in FEATURES]).alias("_bins")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        done = reduce(lambda a, r: a | covered(r), rules, F.lit(False))
        rule: Rule = ()
        while len(rule) < max_terms:
            counts = (
                binned.where(~done & covered(rule)).select("bad", F.explode("_bins").alias("x"))
                .groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            )
            term = _best_term(counts, edges)
            if term is None:
                break
            rule = (*rule, _centred(term, grow.where(~done & covered(rule))))
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        sums = held.where(~done).agg(*[e for k, r in enumerate(prefixes) for e in (
            F.count_if(covered(r) & F.col("bad")).alias(f"p{k}"), F.count_if(covered(r) & ~F.col("bad")).alias(f"n{k}"))]).first()
        worth = [((sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        hits, misses = sums[f"p{k}"], sums[f"n{k}"]
        if hits < min_cover or hits < min_precision * (hits + misses):
            break
        rules.append(prefixes[k])
    return rules


def _centred(term: Term, rows: DataFrame) -> Term:
    """The same split of the rows with the cut in the middle of the gap around it."""
    value = F.col(term.feature)
    low, high = rows.agg(F.max(F.when(value <= term.cut, value)), F.min(F.when(value > term.cut, value))).first()
    return term if low is None or high is None else Term(term.feature, term.above, (low + high) / 2)


def _bin(name: str, edges: list[float]) -> Column:
    """Number of cut points below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda cut: cut < F.col(name)))


def _best_term(counts: list, edges: dict[str, list[float]]) -> Term | None:
    """The threshold with the largest gain: covered bad rows times the bits that their share rises by."""
    tables: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        tables.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best: tuple[float, Term] | None = None
    for name in sorted(tables):
        total_p = sum(p for p, _ in tables[name].values())
        total_n = sum(n for _, n in tables[name].values())
        if not total_p or not total_n:
            return None
        before = math.log2(total_p / (total_p + total_n))
        low_p = low_n = 0
        for b, cut in enumerate(edges[name]):
            p, n = tables[name].get(b, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, hit, miss in ((False, low_p, low_n), (True, total_p - low_p, total_n - low_n)):
                if hit:
                    gain = hit * (math.log2(hit / (hit + miss)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Term(name, above, float(cut))
    return best and best[1]


def describe(rule: Rule) -> str:
    return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:.4g}" for t in rule)


def with_verdict(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, kept and rule (the first that holds, else null) to rows with STATS."""
    fired = F.lit(None).cast("string")
    for rule in reversed(rules):
        fired = F.when(reduce(lambda a, t: a & t.column(), rule, F.lit(True)), describe(rule)).otherwise(fired)
    return stats.drop("base_failed", "kept", "rule").withColumns({"base_failed": base_failed(), "rule": fired}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = written(with_stats(docs.select("doc_id", "text")).drop("text"))
    return with_verdict(stats, learn_rules(stats, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the list keeps, with their own columns. A row's statistics are computed once and
    kept under (doc_id, hash of the text)."""
    keyed = docs.select("doc_id", F.xxhash64(text).alias("_key"), F.col(text).alias("text"))
    stats = written(with_stats(keyed).drop("text"))
    stay = with_verdict(stats, learn_rules(stats, labels)).where("kept").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash")).distinct()
    rows = docs.withColumn("_key", F.xxhash64(text))
    return rows.join(stay, rows["doc_id"].eqNullSafe(stay["_id"]) & (rows["_key"] == stay["_hash"]), "left_semi").select(*docs.columns)
