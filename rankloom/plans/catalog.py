"""Every registered query: name -> function of (spark, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import vectors as vx
from rankloom.operators import (
    cells, chunking, classify, corpus, dense, fusion, hybrid, intervals, learned, lexical, metrics, rerank,
)
from rankloom.plans.study import Study

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def _wide_integers(df: DataFrame) -> DataFrame:
    """Results use one integer width."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(fn: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, path: _wide_integers(fn(Study(spark, path)))
    return fn


RANKED = ["query_id", "rank", "chunk_id", "score"]


# ------------------------------------------------------------------ retrieval
@query
def dense_topk(s: Study) -> DataFrame:
    collection = s.vectors.select(F.col("id").alias("chunk_id"), "vec")
    return dense.nearest(s.label_queries(), collection, s.cfg.candidate_k, cfg=s.cfg).select(RANKED)


@query
def dense_norm_topk(s: Study) -> DataFrame:
    units = s.vectors.select(F.col("id").alias("chunk_id"), vx.unit(F.col("vec")).alias("vec"))
    queries = s.label_queries().select("query_id", vx.unit(F.col("vec")).alias("vec"))
    return dense.nearest(queries, units, 200, cosine=False, cfg=s.cfg).select(RANKED)


@query
def bm25_topk(s: Study) -> DataFrame:
    return s.bm25_list(s.cfg.candidate_k).select(RANKED)


@query
def bm25_statistics(s: Study) -> DataFrame:
    text = F.concat_ws("\n", "title", "body")
    return lexical.collection_stats(lexical.bm25_index(s.chunks, text), lexical.query_terms(s.questions))


@query
def lexical_or_match(s: Study) -> DataFrame:
    return lexical.match_counts(s.chunks, s.questions, F.col("body"))


@query
def lexical_weighted_topk(s: Study) -> DataFrame:
    return hybrid.lexical_list(s.chunks, s.questions, s.cfg.candidate_k, s.cfg).select(RANKED)


@query
def hashed_vector_topk(s: Study) -> DataFrame:
    return hybrid.dense_list(s.chunks, s.questions, s.cfg.candidate_k, s.cfg).select(RANKED)


@query
def hybrid_rrf(s: Study) -> DataFrame:
    return s.shortlists("hybrid").select(RANKED)


@query
def first_stages(s: Study) -> DataFrame:
    """The registry of first stages over all questions, as one batch per stage."""
    return s.shortlists("fts", "vector", "hybrid").groupBy("stage", "query_id").agg(
        F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.count_distinct("doc_id").alias("documents"),
    )


@query
def shortlist_passages(s: Study) -> DataFrame:
    """The late text join of a shortlist: what a judge reads."""
    return s.pairs.select("query_id", "rank", "chunk_id", "title", F.length("passage").alias("n_chars"),
                          F.md5("passage").alias("digest"))


@query
def or_queries(s: Study) -> DataFrame:
    return s.questions.select("query_id", tx.or_query(F.col("question")).alias("or_query"))


@query
def verbatim_gold(s: Study) -> DataFrame:
    return s.gold


# --------------------------------------------------------------------- fusion
def _fused(method: str) -> None:
    def run(s: Study) -> DataFrame:
        return s.fused(method).select(RANKED)

    run.__name__ = f"fuse_{method}"
    query(run)


for _method in fusion.METHODS:
    _fused(_method)


@query
def fuse_normalised(s: Study) -> DataFrame:
    """Min-max scores and ranks of every ranker, before combining."""
    return fusion.ranked_scores(s.ranker_scores()).select(
        "ranker", "query_id", "chunk_id", "pos", F.round("norm", 9).alias("norm")
    )


@query
def fusion_grid_devtest(s: Study) -> DataFrame:
    return s.fusion_grid()


@query
def fusion_top(s: Study) -> DataFrame:
    """The first twelve combinations by their score on the dev half."""
    return fusion.best_by_dev(s.fusion_grid()).select("place", "label", "dev_r1", "test_r1", "test_mrr", "test_ndcg")


@query
def fusion_verdict(s: Study) -> DataFrame:
    return fusion.held_out_verdict(s.fusion_grid())


# ------------------------------------------------------------------- chunking
@query
def doc_windows(s: Study) -> DataFrame:
    return chunking.document_chunks(s.docs, s.cfg).select(
        "chunk_id", "doc_id", "ordinal", F.length("body").alias("n_chars"), F.md5("body").alias("digest")
    )


@query
def line_windows(s: Study) -> DataFrame:
    cut = chunking.line_windows(s.docs, s.cfg.line_window)
    return cut.select("doc_id", "start_line", "end_line", F.md5("body").alias("digest"))


@query
def markdown_chunks(s: Study) -> DataFrame:
    return chunking.markdown_chunks(s.markdown_pages(), s.cfg).select(
        "doc_id", "ordinal", "heading", "heading_path", F.length("body").alias("n_chars"), F.md5("body").alias("digest")
    )


@query
def heading_outline(s: Study) -> DataFrame:
    cut = s.markdown_pages().select("doc_id", F.posexplode(chunking.markdown_sections(F.col("text"))).alias("position", "x"))
    return cut.select("doc_id", "position", "x.heading", "x.path", F.size("x.body").alias("n_lines"))


@query
def heading_features(s: Study) -> DataFrame:
    h = F.col("title")
    return s.page_headings().select(
        "page_id", F.array_join(F.array_sort(tx.heading_tokens(h)), " ").alias("tokens"),
        tx.section_number(h).alias("number"), tx.normalise_heading(h).alias("normal"),
    )


@query
def heading_match(s: Study) -> DataFrame:
    return s.page_headings().select("page_id", tx.headings_match(F.col("title"), F.col("heading")).alias("same"))


@query
def section_mask(s: Study) -> DataFrame:
    """Pages whose gold section (the article heading) is reachable in some chunk of the page."""
    gold = s.page_headings().select(F.col("page_id").alias("doc_id"), F.array("heading").alias("sections"))
    chunks = chunking.markdown_chunks(s.markdown_pages(), s.cfg)
    hit = tx.section_relevant(F.col("sections"), F.col("heading"), F.col("heading_path"))
    return gold.join(chunks, "doc_id", "left").groupBy("doc_id").agg(
        F.max(F.coalesce(hit, F.lit(False))).alias("evaluable"), F.count_if(hit).alias("matching_chunks")
    )


@query
def page_topk(s: Study) -> DataFrame:
    """Ranked heading chunks of pages, for the questions of the page study."""
    return s.page_list().select("query_id", "rank", "doc_id", "ordinal", "score")


@query
def page_section_metrics(s: Study) -> DataFrame:
    return s.page_metrics().select(METRIC_COLUMNS).withColumnRenamed("strategy", "level")


@query
def ir_metrics_section(s: Study) -> DataFrame:
    """Means over the questions each level can be evaluated for."""
    return metrics.aggregate_metrics(s.page_metrics(), ["strategy"]).withColumnRenamed("strategy", "level")


@query
def nearest_headings(s: Study) -> DataFrame:
    """Pages whose own title names no section of theirs, with the headings that come nearest."""
    gold = s.page_headings().select(F.col("page_id").alias("query_id"), F.col("page_id").alias("doc_id"), F.array("title").alias("sections"))
    found = metrics.nearest_headings(gold, s.page_chunks())
    return found.select(F.col("query_id").alias("page_id"), F.size("nearest").alias("n_near"), F.array_join("nearest", " | ").alias("nearest"))


@query
def reachability(s: Study) -> DataFrame:
    """Ground truth that retrieval can reach at all: gold indexed, and how many chunks hold it."""
    listed = s.gold.join(s.chunks, "doc_id").join(s.questions, "query_id")
    holds = F.contains("body", "question")
    found = listed.groupBy("query_id").agg(F.count("*").alias("gold_chunks"), F.count_if(holds).alias("holding_chunks"))
    return s.questions.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("gold_chunks", F.lit(0)).alias("gold_chunks"),
        F.coalesce("holding_chunks", F.lit(0)).alias("holding_chunks"),
    )


@query
def passage_texts(s: Study) -> DataFrame:
    t = tx.passage_text(F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("title")), F.col("lang"), F.col("text"))
    return s.docs.select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


@query
def title_fallback(s: Study) -> DataFrame:
    title = F.when(F.col("lang") == "fr", F.lit("  ")).otherwise(F.concat(F.lit(" "), "title"))
    return s.docs.select("doc_id", tx.title_or_id(title, F.col("doc_id")).alias("title"))


@query
def file_lists(s: Study) -> DataFrame:
    """Comma lists whose items may hold commas, made of the document texts."""
    items = tx.split_file_list(F.replace(F.col("text"), F.lit("."), F.lit(".md,")))
    return s.docs.select("doc_id", F.size(items).alias("n_items"), F.md5(F.array_join(items, "|")).alias("digest"))


@query
def section_lists(s: Study) -> DataFrame:
    items = tx.split_sections(F.translate(F.col("text"), ".", ";"))
    return s.docs.select("doc_id", F.size(items).alias("n_items"), F.md5(F.array_join(items, "|")).alias("digest"))


# --------------------------------------------------------------------- corpus
@query
def qrels_group(s: Study) -> DataFrame:
    return s.gold.groupBy("query_id").agg(
        F.count("*").alias("n_gold"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query
def positive_labels(s: Study) -> DataFrame:
    """Judgments with a positive score, grouped by source."""
    return s.table("labels").where(F.col("quality") > 0).join(s.docs.select("doc_id", "folder"), "doc_id").groupBy(
        "folder"
    ).agg(F.count("*").alias("positives"), F.sum("toxic").cast("long").alias("toxic"))


@query
def evaluable_queries(s: Study) -> DataFrame:
    return s.questions.join(s.gold, "query_id", "left_semi").select("query_id", F.length("question").alias("n_chars"))


@query
def resolved_queries(s: Study) -> DataFrame:
    """A question is usable when it has gold and all of it lies among the labelled documents."""
    refs = s.gold.select("query_id", F.col("doc_id").alias("file"))
    return corpus.resolve(s.questions, refs, s.table("labels").select(F.col("doc_id").alias("file")))


@query
def distractor_pool(s: Study) -> DataFrame:
    return corpus.distractors(s.docs, s.gold, s.cfg, source_rows=s.docs.count())


@query
def corpus_selection(s: Study) -> DataFrame:
    pool = corpus.distractors(s.docs, s.gold, s.cfg, source_rows=s.docs.count())
    return corpus.select_corpus(s.docs, s.gold, pool, s.cfg)


@query
def seeded_draws(s: Study) -> DataFrame:
    return s.table("events").select("event_id", corpus.seeded_draw(F.col("event_id") + 1, s.cfg.seed).alias("draw"))


@query
def question_ids(s: Study) -> DataFrame:
    events = s.table("events")
    node = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    rows = events.select(F.col("event_id").alias("pos"), node.alias("node"))
    return corpus.question_ids(rows, source_rows=events.count()).select("pos", "node", "id")


@query
def corpus_stats(s: Study) -> DataFrame:
    return corpus.chunk_stats(chunking.document_chunks(s.docs, s.cfg), source_rows=s.docs.count())


@query
def embed_cache_misses(s: Study) -> DataFrame:
    """Texts without a cached vector: keys by content, the cache holding the labelled documents."""
    keyed = s.docs.select("doc_id", F.sha2("text", 256).alias("key"))
    cached = keyed.join(s.table("labels").select("doc_id"), "doc_id", "left_semi")
    return corpus.unfinished(keyed, cached, "key").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")
    )


@query
def resume_todo(s: Study) -> DataFrame:
    return corpus.unfinished(s.docs.select("doc_id", "lang"), s.table("labels"), "doc_id")


@query
def last_success_rows(s: Study) -> DataFrame:
    log = s.table("events").select("user_id", "event_id", "event_type", "value")
    return corpus.last_success(log, "user_id", "event_id", F.col("event_type") == "error")


@query
def strategy_append(s: Study) -> DataFrame:
    """A later run replaces the strategies it ran again and keeps the others."""
    log = s.table("events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("score"))
    earlier = log.where(F.col("event_type") != "view").select("event_type", "user_id", F.lit("earlier").alias("run"), "score")
    fresh = log.where(F.col("event_type").isin("view", "click")).select("event_type", "user_id", F.lit("fresh").alias("run"), "score")
    names = fresh.select("event_type").distinct()
    return earlier.join(names, "event_type", "left_anti").unionByName(fresh)


# -------------------------------------------------------------------- metrics
METRIC_COLUMNS = ["strategy", "query_id", "first_rank", *[f"hit_at_{d}" for d in metrics.DEPTHS], "rr", "ndcg"]


@query
def ir_metrics(s: Study) -> DataFrame:
    return s.stage_metrics().select(METRIC_COLUMNS)


@query
def ir_metrics_agg(s: Study) -> DataFrame:
    return metrics.aggregate_metrics(s.stage_metrics(), ["strategy"])


@query
def shortlist_ceiling(s: Study) -> DataFrame:
    return metrics.ceiling(s.stage_metrics(), ["strategy"])


JUDGED = ["query_id", "rank", "first_rank", "chunk_id", "score"]


@query
def rerank_single(s: Study) -> DataFrame:
    return s.reranked("hybrid+single").select(JUDGED)


@query
def rerank_batched(s: Study) -> DataFrame:
    return s.reranked("hybrid+batched").select(JUDGED)


@query
def rerank_graded(s: Study) -> DataFrame:
    return s.reranked("hybrid+graded").select(JUDGED)


@query
def rerank_cascade(s: Study) -> DataFrame:
    return s.reranked("hybrid+cascade").select(JUDGED)


@query
def rerank_precomputed(s: Study) -> DataFrame:
    """Stored scores: the BM25 list as the table; a candidate it lacks has no score."""
    return rerank.rerank(s.shortlists("hybrid").drop("score"), rerank.precomputed_scorer(s.bm25_list(s.cfg.candidate_k))).select(JUDGED)


@query
def rerank_scattered(s: Study) -> DataFrame:
    """The same table read as a cross-encoder answer: a missing score counts as zero."""
    return rerank.rerank(s.shortlists("hybrid").drop("score"), rerank.precomputed_scorer(s.bm25_list(s.cfg.candidate_k), 0.0)).select(JUDGED)


@query
def rerank_metrics_agg(s: Study) -> DataFrame:
    return metrics.aggregate_metrics(s.strategy_metrics(), ["strategy"])


@query
def movement(s: Study) -> DataFrame:
    return metrics.movement(metrics.paired_ranks(s.strategy_metrics(), "hybrid"))


@query
def rescued_broken(s: Study) -> DataFrame:
    return metrics.outcome(metrics.paired_ranks(s.strategy_metrics(), "hybrid"))


@query
def abstention_curve(s: Study) -> DataFrame:
    return metrics.abstention(s.strategy_metrics())


@query
def usage_cost(s: Study) -> DataFrame:
    single = rerank.rerank(s.measured_pairs, s.judge())
    used = [
        rerank.usage(single, mode, s.cfg).withColumn("strategy", F.lit(f"hybrid+{mode}")) for mode in ("single", "batched", "cascade")
    ]
    return rerank.totals(used[0].unionByName(used[1]).unionByName(used[2]), s.cfg.usd_per_million_input)


@query
def judge_requests(s: Study) -> DataFrame:
    """The requests of the batched judge, one row for each."""
    judged = rerank.rerank(s.measured_pairs, s.judges_by_name()["batched"])
    return rerank.requests(judged, s.cfg.batch_size, "first_rank")


@query
def window_judge(s: Study) -> DataFrame:
    """The first thirty line windows of each question judged and re-ordered, the others kept behind them."""
    return s.judged_windows().select(JUDGED)


@query
def judge_summary(s: Study) -> DataFrame:
    return rerank.judge_summary(s.reranked("hybrid+single"))


@query
def latency_percentiles(s: Study) -> DataFrame:
    events = s.table("events")
    return metrics.nearest_rank_percentiles(events, ["event_type"], "value", source_rows=events.count())


@query
def lower_index_percentiles(s: Study) -> DataFrame:
    events = s.table("events")
    return metrics.lower_index_percentiles(events, ["event_type"], "value", source_rows=events.count())


# ---------------------------------------------------------------- line ranges
@query
def file_ranking(s: Study) -> DataFrame:
    return intervals.file_ranks(s.ranked_windows(200)).where(F.col("file_rank") <= 20).select("query_id", "file_rank", "doc_id")


@query
def file_recall(s: Study) -> DataFrame:
    return intervals.file_recall(s.gold, intervals.file_ranks(s.ranked_windows(200)))


@query
def file_recall_at_budget(s: Study) -> DataFrame:
    hits = s.tool_ranges().groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    return intervals.file_recall_at_budget(s.gold, intervals.file_ranks(s.ranked_windows(200)), hits)


@query
def passage_regions(s: Study) -> DataFrame:
    return s.regions()


@query
def region_recall(s: Study) -> DataFrame:
    return intervals.region_recall(s.regions(), intervals.best_ranges(s.tool_ranges()))


@query
def top_ranges(s: Study) -> DataFrame:
    return intervals.best_ranges(s.tool_ranges()).select("query_id", "doc_id", "start_line", "end_line", "range_rank", "p")


@query
def covered_lines(s: Study) -> DataFrame:
    return intervals.covered_lines(intervals.best_ranges(s.tool_ranges()))


@query
def budget_prefix(s: Study) -> DataFrame:
    budget = intervals.covered_lines(intervals.best_ranges(s.tool_ranges()))
    return intervals.budget_prefix(s.ranked_windows(), budget).select("query_id", "rank", "doc_id", "start_line", "end_line", "used")


@query
def region_recall_at_budget(s: Study) -> DataFrame:
    budget = intervals.covered_lines(intervals.best_ranges(s.tool_ranges()))
    return intervals.region_recall(s.regions(), intervals.budget_prefix(s.ranked_windows(), budget))


@query
def zero_hit_queries(s: Study) -> DataFrame:
    """Questions whose gold no ranked window reaches."""
    found = s.gold.join(s.ranked_windows(200).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return s.questions.select("query_id").join(found, "query_id", "left_anti")


# ------------------------------------------------------------- classification
@query
def knn_neighbours(s: Study) -> DataFrame:
    return s.knn()


@query
def neighbour_examples(s: Study) -> DataFrame:
    lists = classify.neighbour_lists(s.knn())
    ids = F.transform("examples", lambda e: F.concat_ws(":", e["train_id"].cast("string"), e["label"].cast("string")))
    return lists.select("id", F.array_join(ids, " ").alias("examples"))


def _flat(rows: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform("top", lambda x: x["label"].cast("string")), " ")
    return rows.select("arm", "id", "gold", "pred", "conf", labels.alias("top_labels"))


@query
def knn_vote(s: Study) -> DataFrame:
    return _flat(s.predictions("knn10"))


@query
def zero_shot_softmax(s: Study) -> DataFrame:
    return _flat(s.predictions("zeroshot"))


@query
def shortlist_labels(s: Study) -> DataFrame:
    """Labels a second chooser may pick from: another arm's top ten plus out-of-scope if absent."""
    top = F.transform("top", lambda x: x["label"])
    allowed = F.array_union(top, F.array(F.lit(0)))
    return s.predictions("knn10").select("id", F.size(allowed).alias("n_labels"), F.array_join(F.array_sort(allowed), " ").alias("labels"))


@query
def accuracy_wilson(s: Study) -> DataFrame:
    return classify.accuracy(s.predictions())


@query
def macro_f1(s: Study) -> DataFrame:
    return classify.macro_f1(s.predictions())


@query
def oos_metrics(s: Study) -> DataFrame:
    return classify.out_of_scope(s.predictions(), 0)


@query
def calibration_error(s: Study) -> DataFrame:
    return classify.calibration_error(classify.gated(s.predictions()))


@query
def gate_validity(s: Study) -> DataFrame:
    return classify.confident_enough(s.predictions())


@query
def coverage_at(s: Study) -> DataFrame:
    return classify.coverage_at(classify.by_confidence(classify.gated(s.predictions()), s.vector_count))


@query
def accuracy_top80(s: Study) -> DataFrame:
    rows = classify.gated(s.predictions())
    sizes = rows.groupBy("arm").agg(F.count("*").alias("n"))
    return classify.accuracy_of_top(classify.by_confidence(rows, s.vector_count), sizes)


@query
def heldout_gate(s: Study) -> DataFrame:
    from rankloom.operators.prefix import running

    rows = running(classify.gated(s.predictions()), ["arm"], [F.col("pos")], source_rows=s.vector_count)
    return classify.held_out_gate(rows.withColumn("idx", F.col("rn") - 1))


@query
def mcnemar(s: Study) -> DataFrame:
    return classify.paired_test(s.predictions("knn10"), s.predictions("zeroshot"))


@query
def parse_labels(s: Study) -> DataFrame:
    """Free-text answers read back as labels."""
    kind = F.col("event_type")
    answer = (
        F.when(kind == "error", "Intent: Error.").when(kind == "view", '"view"!').when(kind == "click", "click on it")
        .when(kind == "signup", "Sign up").otherwise("label: PURCHASE?")
    )
    labels = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return s.table("events").select("event_id", tx.parse_label(answer, labels).alias("label"))


@query
def option_mass(s: Study) -> DataFrame:
    """Token log-probabilities to a label distribution per user; tokens are option numbers."""
    labels = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    token = F.get_json_object("props", "$.k")
    rows = s.table("events").select(
        F.col("user_id").alias("id"), tx.option_label(token, labels).alias("label"), (-F.col("value") / 10.0).alias("logprob")
    )
    best = F.get("top", F.lit(0))
    return classify.option_mass(rows).select("id", best["label"].alias("pred"), best["p"].alias("conf"), F.size("top").alias("options"))


@query
def yesno_probability(s: Study) -> DataFrame:
    top = F.transform(tx.words(F.col("text")), lambda w: F.struct(w.alias("token"), (-F.length(w) / 4.0).alias("logprob")))
    return s.table("conversations").select(
        "conv_id", "turn", F.round(tx.yes_probability(top, F.col("text")), 9).alias("p"), tx.first_digit(F.col("text")).alias("digit")
    )


@query
def cost_per_thousand(s: Study) -> DataFrame:
    """Mean cost of a row per role at a price per million characters, both directions."""
    price = F.when(F.col("role") == "user", 0.4).otherwise(1.6)
    usd = F.length("text") / 1e6 * price
    return s.table("conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.round(F.avg(usd) * 1000, 9).alias("usd_per_1000"),
        F.sum(F.length("text")).alias("units"),
    )


@query
def cost_with_surcharge(s: Study) -> DataFrame:
    """The same with what a role pays beside its requests."""
    price = F.when(F.col("role") == "user", 0.4).otherwise(1.6)
    return classify.cost_per_thousand(s.table("conversations"), "role", F.length("text") / 1e6 * price, {"user": 0.02})


@query
def complete_arms(s: Study) -> DataFrame:
    """Accuracy of the arms that answered every test row; one of the two here stopped early."""
    _, test = classify.split(s.vectors)
    rows = s.predictions("knn10").unionByName(s.predictions("zeroshot").where(F.col("id") % 7 != 0))
    return classify.accuracy(classify.complete_arms(rows, test))


@query
def label_samples(s: Study) -> DataFrame:
    return classify.sample_per_label(s.vectors, 5).select("label", "id")


@query
def reparsed_answers(s: Study) -> DataFrame:
    """Answers of even events were stored without a label and are read again from their text."""
    kind = F.col("event_type")
    raw = F.when(kind == "signup", "Sign up").otherwise(F.concat(F.lit("label: "), F.upper(kind), F.lit("?")))
    labels = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    rows = s.table("events").select("event_id", F.when(F.col("event_id") % 2 == 1, kind).alias("pred"), raw.alias("raw"))
    return classify.reparsed(rows, labels).select("event_id", "pred")


@query
def humanized_labels(s: Study) -> DataFrame:
    return s.table("events").groupBy("event_type").agg(F.count("*").alias("n")).select(
        tx.humanize(F.concat_ws("_", F.lit("event"), "event_type")).alias("label"), "n"
    )


# ------------------------------------------------- learned and approximate (no SQL check)
@query
def tfidf_lr(s: Study) -> DataFrame:
    """Word and character TF-IDF with logistic regression: who wrote a conversation turn."""
    messages = s.table("conversations").select(
        chunking.chunk_key(F.col("conv_id"), F.col("turn")).alias("id"), "text", F.col("role").alias("label")
    )
    train, test = learned.tfidf_features(*classify.split(messages))
    return _flat(classify.prediction_rows(learned.fit_predict(train, test, c=20.0, tol=1e-3), "tfidf-lr"))


@query
def emb_lr(s: Study) -> DataFrame:
    train, test = (learned.vector_features(d) for d in classify.split(s.vectors))
    return _flat(classify.prediction_rows(learned.fit_predict(train, test, c=10.0), "emb-lr"))


@query
def lsh_topk(s: Study) -> DataFrame:
    """Label means against all vectors through the cell index."""
    units = s.vectors.select(F.col("id").alias("chunk_id"), "vec")
    return cells.search(s.label_queries(), units, cells.fit(units, s.cfg.candidate_k), s.cfg.candidate_k, cfg=s.cfg).select(RANKED)


def _vectors_asked(s: Study) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every vector whose id is divisible by 100, and all vectors."""
    units = s.vectors.select(F.col("id").alias("chunk_id"), "vec")
    return units.where(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "query_id"), units


@query
def cells_topk(s: Study) -> DataFrame:
    queries, units = _vectors_asked(s)
    return cells.search(queries, units, cells.fit(units, s.cfg.candidate_k), s.cfg.candidate_k, cfg=s.cfg).select(RANKED)


@query
def cells_recall(s: Study) -> DataFrame:
    """The cell index against exact search over all vectors: does it find nine tenths of the true neighbours?"""
    queries, units = _vectors_asked(s)
    k = s.cfg.candidate_k
    exact = dense.nearest(queries, units, k, cfg=s.cfg)
    found = cells.search(queries, units, cells.fit(units, k), k, cfg=s.cfg)
    return cells.recall(exact, found).select("n_queries", "n_wanted", (F.col("recall") >= 0.9).alias("enough"))


@query
def lexical_stemmed_topk(s: Study) -> DataFrame:
    """The weighted match over Finnish stems without stop words."""
    return lexical.stemmed_topk(s.chunks, s.questions, F.col("title"), F.col("body"), s.cfg.candidate_k, s.cfg).select(RANKED)
