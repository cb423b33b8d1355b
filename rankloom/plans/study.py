"""The study on the given tables: each function builds one declarative plan.

``documents`` are the corpus, ``benchmark`` items the questions (gold = documents that hold the
item verbatim), ``embeddings`` the labelled vectors, ``pages`` the documents with headings,
``events`` and ``conversations`` the logs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.text import passage_text
from rankloom.operators import chunking, classify, dense, fusion, hybrid, intervals, lexical, metrics, rerank
from rankloom.operators.prefix import running
from rankloom.session import spread, stored

BUDGET_TOOL_HITS = 10
LINE_WINDOW = 10
WINDOW_HEAD, WINDOW_BATCH = 30, 10


def _document_of(chunk_id: str) -> Column:
    return F.shiftright(F.col(chunk_id), chunking.ID_BITS)


@dataclass(frozen=True)
class Study:
    spark: SparkSession
    path: str
    cfg: Config = DEFAULTS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # ------------------------------------------------------------- retrieval

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    @cached_property
    def question_count(self) -> int:
        return self.questions.count()

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", F.col("source").alias("title"), F.col("source").alias("folder"), "lang", "text"
        )

    @cached_property
    def texts(self) -> DataFrame:
        """The documents as they are cut and tokenised."""
        return spread(self.docs, "doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.document_chunks(self.texts, self.cfg)

    @cached_property
    def gold(self) -> DataFrame:
        return stored(lexical.verbatim_gold(self.texts, self.questions))

    @cached_property
    def evaluable(self) -> DataFrame:
        """Questions with gold, which the halves of the fusion grid are made of."""
        return self.questions.join(self.gold, "query_id", "left_semi")

    def bm25_list(self, k: int) -> DataFrame:
        return stored(lexical.bm25_topk(self.chunks, self.questions, F.concat_ws("\n", "title", "body"), k, self.cfg))

    def shortlists(self, *stages: str) -> DataFrame:
        return hybrid.shortlists(self.chunks, self.questions, list(stages), cfg=self.cfg).withColumn(
            "doc_id", _document_of("chunk_id")
        )

    def with_passages(self, listed: DataFrame) -> DataFrame:
        """Late join of the wide text: only documents with a listed chunk are cut again, and only these chunks kept."""
        listed = stored(listed.drop("doc_id").withColumn("_doc", _document_of("chunk_id")))
        docs = self.docs.join(listed.select(F.col("_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
        full = chunking.document_chunks(docs, self.cfg).join(listed.drop("_doc"), "chunk_id").join(self.questions, "query_id")
        return full.withColumn("passage", passage_text(F.col("title"), F.lit(""), F.col("body"))).drop("body", "ordinal")

    # ---------------------------------------------------------------- rerank

    @cached_property
    def pairs(self) -> DataFrame:
        return self.with_passages(self.shortlists("hybrid")).drop("score", "stage")

    @cached_property
    def measured_pairs(self) -> DataFrame:
        return rerank.measured(self.pairs)

    def judge(self) -> rerank.Scorer:
        return rerank.overlap_scorer()

    def judges_by_name(self) -> dict[str, rerank.Scorer]:
        single = self.judge()
        return {"single": single, "batched": rerank.batched_scorer(single, self.cfg.batch_size)}

    def judges(self) -> dict:
        single = self.judge()
        batched = rerank.batched_scorer(single, self.cfg.batch_size, relative=True)
        return {
            "hybrid": lambda p: p.withColumn("score", F.lit(None).cast("double")),
            "hybrid+single": lambda p: rerank.rerank(p, single),
            "hybrid+batched": lambda p: rerank.rerank(p, batched),
            "hybrid+graded": lambda p: rerank.rerank(p, rerank.graded_scorer()),
            "hybrid+cascade": lambda p: rerank.cascade(p, batched, single, self.cfg.cascade_keep),
        }

    STRATEGIES = ["hybrid", "hybrid+single", "hybrid+batched", "hybrid+graded", "hybrid+cascade"]

    def reranked(self, *names: str) -> DataFrame:
        """(strategy, query_id, doc_id, chunk_id, rank, score, ...) for the named strategies, default all."""
        wanted = {n: run for n, run in self.judges().items() if not names or n in names}
        return rerank.judge_each(self.measured_pairs, wanted)

    def stage_metrics(self) -> DataFrame:
        listed = self.shortlists("fts", "vector", "hybrid").withColumnRenamed("stage", "strategy")
        return self._metrics(listed, ["fts", "vector", "hybrid"])

    def strategy_metrics(self) -> DataFrame:
        return self._metrics(self.reranked(), self.STRATEGIES, top_score=True)

    def _metrics(self, listed: DataFrame, names: list[str], top_score: bool = False) -> DataFrame:
        flagged = metrics.flag_relevant(listed, self.gold)
        per_query = metrics.query_metrics(flagged, ["strategy", "query_id"], self.cfg, top_score)
        return metrics.keep_empty(per_query, self.questions, names)

    # ---------------------------------------------------------------- fusion

    RANKERS = ["lexical", "dense", "overlap"]

    def ranker_scores(self) -> DataFrame:
        """Three rankers over the hybrid shortlist; a list that misses a candidate gives NULL."""
        depth = self.cfg.fetch_depth
        lex = stored(hybrid.lexical_list(self.chunks, self.questions, depth, self.cfg))
        den = stored(hybrid.dense_list(self.chunks, self.questions, depth, self.cfg))
        short = hybrid.reciprocal_rank_fusion({"lexical": lex, "dense": den}, self.cfg.candidate_k, self.cfg)
        base = short.select("query_id", "chunk_id", F.col("rank").alias("first_rank"), "lexical", "dense")
        judged = self.judge()(self.with_passages(base)).drop("overlap").withColumnRenamed("score", "overlap")
        long = F.explode(F.array(*[F.struct(F.lit(n).alias("ranker"), F.col(n).alias("score")) for n in self.RANKERS]))
        return judged.select("query_id", "chunk_id", "first_rank", long.alias("s")).select(
            "query_id", "chunk_id", "first_rank", "s.ranker", "s.score"
        )

    def fused(self, method: str) -> DataFrame:
        return fusion.fuse(self.ranker_scores(), method, self.cfg)

    def fusion_grid(self) -> DataFrame:
        """Every combination scored on both halves of the questions that have gold."""
        scores = self.ranker_scores().withColumn("doc_id", _document_of("chunk_id"))
        lists = fusion.fuse_grid(metrics.flag_relevant(scores, self.gold), self.RANKERS, self.cfg, ["rel"])
        scored = metrics.query_metrics(lists, ["combo", "query_id"], self.cfg)
        halves = running(self.evaluable.select("query_id"), [], [F.col("query_id")], source_rows=self.question_count).select(
            "query_id", F.when(F.col("rn") % 2 == 1, "dev").otherwise("test").alias("half")
        )
        mean = lambda c, h: F.round(F.avg(F.when(F.col("half") == h, F.col(c))), 9)
        combos = scored.join(halves, "query_id").groupBy("combo").agg(
            mean("hit_at_1", "dev").alias("dev_r1"), mean("hit_at_1", "test").alias("test_r1"),
            mean("rr", "test").alias("test_mrr"), mean("ndcg", "test").alias("test_ndcg"),
        )
        name = fusion.grid_names(self.RANKERS)[F.col("combo")]
        return combos.select("combo", name["label"].alias("label"), name["n_rankers"].alias("n_rankers"),
                             "dev_r1", "test_r1", "test_mrr", "test_ndcg")

    # ------------------------------------------------------------ line ranges

    @cached_property
    def line_windows(self) -> DataFrame:
        return self._line_windows(self.texts)

    def _line_windows(self, docs: DataFrame) -> DataFrame:
        cut = chunking.line_windows(docs, LINE_WINDOW)
        return cut.withColumn("chunk_id", chunking.chunk_key(F.col("doc_id"), F.col("start_line"))).withColumn(
            "title", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
        )

    def _ranges(self, ranked: DataFrame, keep: int) -> DataFrame:
        """Line bounds of the listed windows; only their documents are cut again."""
        top = stored(ranked.where(F.col("rank") <= keep).select("query_id", "chunk_id", "rank", "score"))
        docs = self.docs.join(top.select(_document_of("chunk_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return self._line_windows(docs).select("chunk_id", "doc_id", "start_line", "end_line").join(top, "chunk_id")

    def ranked_windows(self, keep: int = 120) -> DataFrame:
        """The BM25 ranking of line windows, with their bounds: 120 for the list, 200 for ranking files."""
        return self._ranges(
            lexical.bm25_topk(self.line_windows, self.questions, F.concat_ws("\n", "title", "body"), 200, self.cfg), keep
        )

    def judged_windows(self) -> DataFrame:
        """The ranked windows with the head judged on its own lines; the tail needs no text."""
        listed = stored(self.ranked_windows())
        head = listed.where(F.col("rank") <= WINDOW_HEAD).select("query_id", "chunk_id", "doc_id")
        docs = self.docs.join(head.select("doc_id").distinct(), "doc_id", "left_semi")
        bodies = self._line_windows(docs).select("chunk_id", F.col("body").alias("passage")).join(head, "chunk_id").join(self.questions, "query_id")
        known = rerank.measured(bodies).drop("doc_id")
        first = listed.select("query_id", "chunk_id", F.col("rank").alias("first_rank")).join(known, ["query_id", "chunk_id"], "left")
        return rerank.judge_head(first, rerank.batched_scorer(self.judge(), WINDOW_BATCH), WINDOW_HEAD, "first_rank")

    def tool_ranges(self) -> DataFrame:
        """The budget tool: best word-match windows, as ranges with a probability-like ``p``."""
        listed = lexical.weighted_topk(self.line_windows, self.questions, F.lit(""), F.col("body"), BUDGET_TOOL_HITS * 3, cfg=self.cfg)
        p = F.when(F.col("rank") % 5 != 0, F.round(F.col("score") / (F.col("score") + 10.0), 6))
        return self._ranges(listed, BUDGET_TOOL_HITS * 3).withColumn("p", p).withColumnRenamed("rank", "pos")

    def regions(self) -> DataFrame:
        return intervals.passage_regions(self.docs, self.questions, self.gold)

    # ---------------------------------------------------------- classification

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))

    @cached_property
    def vector_count(self) -> int:
        return self.vectors.count()

    def knn(self) -> DataFrame:
        train, test = classify.split(self.vectors)
        return classify.neighbours(train, test, self.cfg.neighbours, self.cfg)

    def predictions(self, *arms: str) -> DataFrame:
        train, test = classify.split(self.vectors)
        made = {
            "knn10": lambda: classify.knn_vote(classify.neighbours(train, test, self.cfg.neighbours, self.cfg), test),
            "zeroshot": lambda: classify.zero_shot(test, dense.centroids(train, "label", "vec"), cfg=self.cfg),
        }
        out = None
        for arm in arms or made:
            rows = made[arm]().withColumn("pos", F.col("id"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def label_queries(self, unit: Column | None = None) -> DataFrame:
        """One query vector per label: the label's mean vector."""
        return dense.centroids(self.vectors, "label", "vec").select(F.col("anchor").alias("query_id"), "vec")

    # ----------------------------------------------------------------- pages

    def markdown_pages(self) -> DataFrame:
        """Pages as markdown: the title and the article heading become headings, blocks become paragraphs."""
        html = F.col("html")
        for pattern, to in PAGE_RULES:
            html = F.regexp_replace(html, pattern, to)
        return spread(self.table("pages"), "page_id").select(F.col("page_id").alias("doc_id"), html.alias("text"))

    def page_chunks(self) -> DataFrame:
        cut = chunking.markdown_chunks(self.markdown_pages(), self.cfg)
        return cut.withColumn("chunk_id", chunking.chunk_key(F.col("doc_id"), F.col("ordinal")))

    @cached_property
    def cut_pages(self) -> DataFrame:
        """The chunks of all pages, cut once for the index, the headings of the list and the pool of sections."""
        return stored(self.page_chunks())

    @cached_property
    def heading_questions(self) -> DataFrame:
        """What the metrics are taken over: the article heading of every page."""
        asked = self.page_headings().where(F.col("page_id").isNotNull())
        return asked.select(F.col("page_id").alias("query_id"), F.col("heading").alias("question"))

    @cached_property
    def page_questions(self) -> DataFrame:
        """The stated query set of the list: the article heading of every page whose id is divisible by 10."""
        return self.heading_questions.where(F.col("query_id") % 10 == 0)

    def page_gold(self) -> DataFrame:
        return self.heading_questions.select("query_id", F.col("query_id").alias("doc_id"), F.array("question").alias("sections"))

    def page_list(self, questions: DataFrame | None = None) -> DataFrame:
        """BM25 over heading chunks with their heading path, and the headings of the listed chunks; ``page_questions`` by default.

        Pages that ask the same are searched once, by the smallest of their ids, and get its list in the end.
        """
        text = F.concat_ws("\n", "heading_path", "body")
        questions = self.page_questions if questions is None else questions
        asked = stored(questions.groupBy("query_id").agg(F.array_sort(F.collect_list("question")).alias("asked")))
        once = stored(asked.groupBy("asked").agg(F.min("query_id").alias("first")))
        searched = once.select(F.col("first").alias("query_id"), F.explode("asked").alias("question"))
        top = stored(lexical.bm25_topk(self.cut_pages, searched, text, self.cfg.candidate_k, self.cfg))
        listed = self.cut_pages.select("chunk_id", "doc_id", "ordinal", "heading", "heading_path").join(top, "chunk_id")
        return listed.withColumnRenamed("query_id", "first").join(asked.join(once, "asked").select("query_id", "first"), "first").drop("first")

    def page_metrics(self) -> DataFrame:
        """Both levels for every question that the level can be evaluated for: its section exists in some chunk."""
        gold = self.page_gold()
        flagged = metrics.by_level(metrics.flag_sections(self.page_list(self.heading_questions), gold))
        pool = metrics.flag_sections(self.cut_pages.select("doc_id", "heading", "heading_path").join(gold.select("query_id", "doc_id"), "doc_id"), gold)
        asked = metrics.by_level(pool).where("rel").select(F.col("level").alias("strategy"), "query_id").distinct()
        scored = metrics.query_metrics(flagged.withColumnRenamed("level", "strategy"), ["strategy", "query_id"], self.cfg)
        return metrics.fill_empty(asked, scored)

    def page_headings(self) -> DataFrame:
        grab = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
        return self.table("pages").select("page_id", grab("title").alias("title"), grab("h1").alias("heading"))


# HTML blocks to markdown, in order. The same rules feed the SQL check.
PAGE_RULES = [
    ("<style>[^<]*</style>", ""),
    ("<script>[^;]*;[^<]*</script>", ""),
    ("<!--[^>]*-->", ""),
    ("<title>([^<]*)</title>", "\n# $1\n"),
    ("<h1>([^<]*)</h1>", "\n## $1\n"),
    ("<nav>", "\n## Navigation\n"),
    ("<footer>", "\n### Footer\n"),
    ("<li>", "\n- "),
    ("<p>", "\n\n"),
    ("<br>", "\n"),
    ("<[^>]*>", ""),
]
