"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import (
    bloom_search, bpe, decontaminate, filter_audit, html_wrappers, line_dedup, lm_score, ngram_join, quality_rules, quartile_digest, quote_chat,
    toxicity, url_filter,
)
from rankloom.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_ngram_join": lambda s, d: ngram_join.query(table(s, d, "documents")),
    "op2_quality_rules": lambda s, d: quality_rules.query(table(s, d, "documents"), table(s, d, "labels")),
    "op3_decontaminate": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
    "op4_html_wrappers": lambda s, d: html_wrappers.query(table(s, d, "pages")),
    "op5_lm_score": lambda s, d: lm_score.query(table(s, d, "documents")),
    "op6_quote_chat": lambda s, d: quote_chat.query(table(s, d, "conversations")),
    "op7_line_dedup": lambda s, d: line_dedup.query(table(s, d, "documents")),
    "op8_bpe": lambda s, d: bpe.query(table(s, d, "documents")),
    "op9_url_filter": lambda s, d: url_filter.query(table(s, d, "pages")),
    "op10_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
    "op11_quartile_digest": lambda s, d: quartile_digest.query(table(s, d, "documents")),
    "op12_filter_audit": lambda s, d: filter_audit.query(table(s, d, "documents"), table(s, d, "labels")),
    "op13_bloom_search": lambda s, d: bloom_search.query(table(s, d, "documents"), table(s, d, "benchmark")),
}

ORACLE: dict[str, str] = {"op5_lm_score": lm_score.SQL, "op6_quote_chat": quote_chat.SQL,
                          "op7_line_dedup": line_dedup.SQL, "op9_url_filter": url_filter.SQL,
                          "op12_filter_audit": filter_audit.SQL, "op13_bloom_search": bloom_search.SQL}
