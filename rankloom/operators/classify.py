"""Vector classifiers and classification metrics.

Predictions are rows ``(arm, id, gold, pred, conf, top)``; ``top`` is an array of (label, p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.stats import exact_sign_p, wilson
from rankloom.functions.text import parse_label
from rankloom.operators.dense import nearest, similarities
from rankloom.operators.prefix import running
from rankloom.session import stored


def hash_share(key: Column) -> Column:
    """A fixed pseudo-random share in [0,1) of an id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def split(vectors: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test: every row is in exactly one of them."""
    marked = vectors.withColumn("_share", hash_share(F.col("id")))
    test = F.col("_share") < test_share
    return marked.where(~test).drop("_share"), marked.where(test).drop("_share")


def sample_per_label(rows: DataFrame, n: int, label: str = "label", key: str = "id") -> DataFrame:
    """``n`` rows of each label, drawn by a hash of the key; a hot label is cut to ``n`` in every task first."""
    order = Window.partitionBy(label).orderBy(hash_share(F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def by_probability(pairs: Column) -> Column:
    """Pairs (label, p) by p descending, then label."""
    keyed = F.transform(pairs, lambda x: F.struct((-x["p"]).alias("m"), x["label"].alias("label"), x["p"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))


def prediction_rows(shares: DataFrame, arm: str) -> DataFrame:
    """``shares(id, gold, pairs)`` to prediction rows with the ten most probable labels."""
    ranked = shares.select("id", "gold", by_probability(F.col("pairs")).alias("r"))
    return ranked.select(
        F.lit(arm).alias("arm"), "id", "gold",
        F.get("r", F.lit(0))["label"].alias("pred"),
        F.get("r", F.lit(0))["p"].alias("conf"),
        F.slice("r", 1, 10).alias("top"),
    )


def neighbours(train: DataFrame, test: DataFrame, k: int = DEFAULTS.neighbours, cfg: Config = DEFAULTS) -> DataFrame:
    """The ``k`` most similar labelled rows of each test row: (id, rank, train_id, label, sim)."""
    near = nearest(
        test.select(F.col("id").alias("query_id"), "vec"), train.select(F.col("id").alias("chunk_id"), "vec"), k, cfg=cfg
    )
    labels = train.select(F.col("id").alias("chunk_id"), "label")
    return near.join(labels, "chunk_id").select(
        F.col("query_id").alias("id"), "rank", F.col("chunk_id").alias("train_id"), "label", F.col("score").alias("sim")
    )


def neighbour_lists(near: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "train_id", "label")))
    return near.groupBy("id").agg(
        F.transform(ordered, lambda e: F.struct(e["train_id"].alias("train_id"), e["label"].alias("label"))).alias("examples")
    )


def knn_vote(near: DataFrame, test: DataFrame, arm: str = "knn10") -> DataFrame:
    """Similarity-weighted vote over the neighbours, as a share of all votes of the row."""
    votes = near.groupBy("id", "label").agg(F.sum("sim").alias("v"))
    per_row = votes.groupBy("id").agg(F.sum("v").alias("total"), F.collect_list(F.struct("label", "v")).alias("votes"))
    shares = per_row.select(
        "id",
        F.transform("votes", lambda x: F.struct(
            x["label"].alias("label"), F.round(F.try_divide(x["v"], F.col("total")), 9).alias("p"))).alias("pairs"),
    )
    gold = test.select("id", F.col("label").alias("gold"))
    return prediction_rows(gold.join(shares, "id"), arm)


def zero_shot(test: DataFrame, anchors: DataFrame, arm: str = "zeroshot", cfg: Config = DEFAULTS) -> DataFrame:
    """Softmax over the similarity to one vector per label, shifted by the row's maximum."""
    sims = similarities(test.select("id", "vec"), anchors, cfg=cfg)
    high = F.array_max(F.transform("sims", lambda s: s["sim"]))
    weights = sims.select("id", F.transform(
        "sims", lambda s: F.struct(s["anchor"].cast("int").alias("label"), F.exp((s["sim"] - high) / cfg.temperature).alias("w"))
    ).alias("ws"))
    total = F.aggregate("ws", F.lit(0.0).cast("double"), lambda a, x: a + x["w"])
    shares = weights.select("id", F.transform(
        "ws", lambda x: F.struct(x["label"].alias("label"), F.round(x["w"] / total, 9).alias("p"))).alias("pairs"))
    gold = test.select("id", F.col("label").alias("gold"))
    return prediction_rows(gold.join(shares, "id"), arm)


def is_correct() -> Column:
    return F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))


def accuracy(rows: DataFrame) -> DataFrame:
    right, n = F.count_if(is_correct()), F.count("*")
    base = rows.groupBy("arm").agg(n.alias("n"), right.alias("right"), F.count_if(F.col("pred").isNull()).alias("errors"))
    low, high = wilson(F.col("right"), F.col("n"))
    return base.select(
        "arm", "n", "right", "errors", F.round(F.col("right") / F.col("n"), 9).alias("accuracy"),
        F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"),
    )


def complete_arms(rows: DataFrame, test: DataFrame) -> DataFrame:
    """The rows of arms that answered every row of ``test(id, ...)``; an arm that stopped half way is not compared."""
    rows = stored(rows)
    own = rows.join(test.select("id").distinct(), "id", "left_semi")
    whole = own.groupBy("arm").agg(F.count_distinct("id").alias("_n")).where(F.col("_n") >= F.lit(test.select("id").distinct().count())).select("arm")
    return own.join(whole, "arm", "left_semi")


def reparsed(rows: DataFrame, labels: Column) -> DataFrame:
    """Stored answers without a label read again from their ``raw`` text; a stored label stands."""
    return rows.withColumn("pred", F.coalesce("pred", parse_label(F.col("raw"), labels)))


def models(rows: DataFrame) -> DataFrame:
    """The models that answered for each arm, by name; a handful at most."""
    named = rows.where(F.length("model") > 0).select("arm", "model").distinct()
    return named.groupBy("arm").agg(F.array_sort(F.collect_list("model")).alias("models"))


def cost_per_thousand(rows: DataFrame, by: str, usd: Column, surcharge: dict[str, float] | None = None) -> DataFrame:
    """Rows of each group and their mean cost for a thousand, plus what its group pays beside the requests."""
    extra = F.coalesce(*[F.when(F.col(by) == name, F.lit(float(more))) for name, more in (surcharge or {}).items()], F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(usd).alias("_mean")).select(
        by, "n", F.round(F.col("_mean") * 1000 + extra, 9).alias("usd_per_1000"))


def label_counts(rows: DataFrame) -> DataFrame:
    """Per arm and label: true positives, predicted and gold counts, in one pass of partial sums."""
    hits = rows.select("arm", F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), is_correct().cast("int").alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp")),
    )).alias("h")).select("arm", "h.*")
    return hits.where(F.col("label").isNotNull()).groupBy("arm", "label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("gold")
    )


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 over the labels that occur in gold."""
    per = label_counts(rows).where(F.col("gold") > 0)
    f1 = 2.0 * F.col("tp") / (F.col("predicted") + F.col("gold"))
    return per.groupBy("arm").agg(F.count("*").alias("labels"), F.round(F.avg(f1), 9).alias("macro_f1"))


def out_of_scope(rows: DataFrame, oos_label) -> DataFrame:
    gold, pred = F.col("gold") == oos_label, F.coalesce(F.col("pred") == oos_label, F.lit(False))
    share = lambda hit, base: F.round(F.coalesce(F.try_divide(F.count_if(hit), F.count_if(base)), F.lit(0.0)), 9)
    return rows.groupBy("arm").agg(
        F.count_if(gold).alias("n_oos"),
        share(~gold & is_correct(), ~gold).alias("in_scope_accuracy"),
        share(gold & is_correct(), gold).alias("oos_recall"),
        share(pred & gold, pred).alias("oos_precision"),
    )


def calibration_bins(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    clamped = F.least(F.greatest("conf", F.lit(0.0)), F.lit(0.9999))
    return rows.groupBy("arm", F.floor(clamped * 10).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(is_correct().cast("double")).alias("accuracy"), F.avg("conf").alias("confidence")
    )


def calibration_error(rows: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return calibration_bins(rows).groupBy("arm").agg(F.round(F.sum(gap) / F.sum("n"), 9).alias("ece"))


def confident_enough(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """Arms whose rows nearly all carry a confidence; only those can be gated."""
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.count("conf").alias("with_conf")).where(
        F.col("with_conf") >= F.col("n") * share
    )


def gated(rows: DataFrame) -> DataFrame:
    """The rows of arms that can be gated. ``rows`` are computed once, into a table, and read for both uses."""
    rows = stored(rows)
    return rows.join(confident_enough(rows), "arm", "left_semi")


def by_confidence(rows: DataFrame, source_rows: int | None = None) -> DataFrame:
    """Rows with their place in confidence order (ties by ``pos``) and the running number right."""
    filled = rows.withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    return running(filled, ["arm"], [F.col("conf").desc(), F.col("pos")], {"right_so_far": is_correct().cast("int")}, source_rows)


def coverage_at(ranked: DataFrame, targets=(0.95, 0.98)) -> DataFrame:
    """Largest share of rows, most confident first, that keeps the target accuracy."""
    good = lambda t: F.max(F.when(F.col("right_so_far") / F.col("rn") >= t, F.col("rn")).otherwise(0))
    return ranked.groupBy("arm").agg(
        F.count("*").alias("n"),
        *[F.round(good(t) / F.count("*"), 9).alias(f"coverage_{int(t * 100)}") for t in targets],
    )


def accuracy_of_top(ranked: DataFrame, sizes: DataFrame, share: float = 0.8) -> DataFrame:
    """Accuracy on the most confident ``share`` (half-even number of rows). ``sizes(arm, n)``."""
    top = F.bround(F.col("n") * share, 0).cast("long")
    return ranked.join(sizes, "arm").where(F.col("rn") <= top).groupBy("arm").agg(
        F.count("*").alias("kept"), F.round(F.avg(is_correct().cast("double")), 9).alias("accuracy_top")
    )


def held_out_gate(rows: DataFrame, target: float = 0.95) -> DataFrame:
    """Smallest confidence threshold that is accurate enough on even positions, replayed on odd ones.

    ``rows`` carry ``idx``, the 0-based position in the sample. Thresholds are confidences at four
    places, so dev rows are first counted on that grid (at most 10,001 cells per arm).
    """
    rows = rows.withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    dev = rows.where(F.col("idx") % 2 == 0)
    cell = F.bround("conf", 4)
    grid = F.round(cell * 10000, 0).cast("int")
    reach = F.when(F.col("conf") >= cell, grid).otherwise(grid - 1)
    counted = (
        dev.select("arm", F.explode(F.array(
            F.struct(reach.alias("g"), F.lit(1).alias("n"), is_correct().cast("int").alias("right"), F.lit(False).alias("is_step")),
            F.struct(grid.alias("g"), F.lit(0).alias("n"), F.lit(0).alias("right"), F.lit(True).alias("is_step")),
        )).alias("c"))
        .select("arm", "c.*")
        .groupBy("arm", "g")
        .agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.max("is_step").alias("is_step"))
    )
    above = Window.partitionBy("arm").orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.select("arm", "g", "is_step", F.sum("n").over(above).alias("n"), F.sum("right").over(above).alias("right"))
    fits = F.col("is_step") & (F.col("n") > 0) & (F.col("right") >= F.col("n") * target)
    chosen = reached.groupBy("arm").agg((F.min(F.when(fits, F.col("g"))) / 10000.0).alias("threshold"))
    test = rows.where(F.col("idx") % 2 == 1).join(chosen, "arm")
    kept = F.coalesce(F.col("conf") >= F.col("threshold"), F.lit(False))
    return test.groupBy("arm").agg(
        F.max("threshold").alias("threshold"),
        F.round(F.count_if(kept) / F.count("*"), 9).alias("coverage"),
        F.round(F.coalesce(F.try_divide(F.count_if(kept & is_correct()), F.count_if(kept)), F.lit(0.0)), 9).alias("accuracy"),
    )


def paired_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact McNemar over the ids both arms answered."""
    right = lambda d, n: d.select("id", is_correct().alias(n))
    both = right(a, "a").join(right(b, "b"), "id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(F.col("b") & ~F.col("a")).alias("only_b"),
    )
    return both.withColumn("p_value", F.round(exact_sign_p("only_a", "only_b"), 9))


def option_mass(tokens: DataFrame) -> DataFrame:
    """``tokens(id, label, logprob)``: normalised probability per label, unlabelled tokens ignored."""
    mass = tokens.where(F.col("label").isNotNull()).groupBy("id", "label").agg(F.sum(F.exp("logprob")).alias("m"))
    per = mass.groupBy("id").agg(F.sum("m").alias("total"), F.collect_list(F.struct("label", "m")).alias("ms"))
    return per.select("id", by_probability(F.transform(
        "ms", lambda x: F.struct(x["label"].alias("label"), F.round(x["m"] / F.col("total"), 9).alias("p")))).alias("top"))
