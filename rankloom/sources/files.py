"""File sources: document trees, delimited ground truth, JSON suites, labelled messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators.corpus import question_ids
from rankloom.operators.prefix import running

# Files that sit beside a corpus without belonging to it; source files worth indexing.
HOUSEKEEPING = ["links.md", "readme.md", "index.md", "manifest.md"]
SOURCE_FILES = r"\.(c|h|py|y|l|go)$|(^|/)README[^/]*$"


def markdown_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, folder, title, path, bytes, text)``: one row per markdown file name below ``folder``.

    Of equal names the first path wins; the choice is an aggregate, so copies are reduced
    before they are shuffled.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    parts = F.split("path", "/")
    named = raw.select(
        F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), "path",
        F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"),
    ).where(~F.lower("file").isin(HOUSEKEEPING))
    first = named.groupBy("file").agg(F.min_by(F.struct("folder", "path", "bytes", "text"), "path").alias("d"))
    return first.select("file", "d.folder", tx.strip_title(F.col("file")).alias("title"), "d.path", "d.bytes", "d.text")


def in_reading_order(docs: DataFrame) -> DataFrame:
    """By file name as a Finnish reader sorts it."""
    return docs.orderBy(F.collate("file", "fi"), "file")


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, text)`` of the source files below ``folder``; malformed bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    relative = F.substring_index("path", root, -1)
    files = raw.select(relative.alias("file"), "content").where(F.col("file").rlike(SOURCE_FILES))
    return files.select("file", _lenient_text(F.col("content")).alias("text"))


def _lenient_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def delimited(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Quoted, multi-line delimited text: trimmed header and cells, short rows padded, blank rows dropped.

    Line ends inside quotes stay as they are in files whose rows end in a line feed; where rows end in carriage return and
    line feed, Spark's reader makes those inside quotes line feeds too.
    """
    return placed_delimited(spark, path, sep).drop(*PLACE)


def placed_delimited(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    raw = placed(spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE"))
    cells = {c: tx.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in raw.columns if c not in PLACE}
    tidy = raw.select(*[v.alias(c.lstrip("﻿").strip()) for c, v in cells.items()], *PLACE)
    filled = [F.length(F.col(f"`{c}`")) > 0 for c in tidy.columns if c not in PLACE]
    return tidy.where(F.exists(F.array(*filled), lambda x: x))


PLACE = ["_file", "_block", "_line"]


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a file scan with the place they were read from. Tasks take files by size, so only the file's path, the
    block's offset and the order inside the block give the order of the input."""
    return df.select(*(columns or ["*"]), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"))


def numbered(df: DataFrame, name: str = "pos", source_rows: int | None = None) -> DataFrame:
    """A gapless 0-based position in file order (files by path) of ``placed`` rows."""
    return running(df, [], [F.col(c) for c in PLACE], source_rows=source_rows).withColumn(name, F.col("rn") - 1).drop("rn", *PLACE)


def ground_truth(spark: SparkSession, path: str, source_rows: int | None = None) -> DataFrame:
    """Question rows of the delimited ground truth with unique ids and parsed file and section lists."""
    rows = placed_delimited(spark, path)
    for absent in {"node", "question", "files", "source_sections", "category", "hop_type", "answer"} - set(rows.columns):
        rows = rows.withColumn(absent, F.lit(""))
    asked = numbered(rows.where(F.length("question") > 0), source_rows=source_rows)
    return question_ids(asked, source_rows).select(
        "pos", "id", "node", "question",
        tx.split_file_list(F.col("files")).alias("files"), tx.split_sections(F.col("source_sections")).alias("sections"),
        "category", F.col("hop_type"), "answer",
    )


def judged_collection(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A published retrieval set: ``docs``, the questions with a positive judgment, and their gold."""
    gold = spark.read.parquet(qrels).where(F.col("score") > 0).select(
        F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id")
    )
    docs = spark.read.parquet(corpus).select(
        F.col("id").alias("doc_id"), tx.title_or_id(F.col("title"), F.col("id")).alias("title"),
        tx.strip(F.coalesce("title", F.lit(""))).alias("heading"), F.coalesce("text", F.lit("")).alias("text"),
    )
    questions = spark.read.parquet(queries).select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    return docs, questions.join(gold, "query_id", "left_semi"), gold


def labelled_messages(spark: SparkSession, path: str, prefix: str, label: str = "label_text",
                      names: dict[int, str] | None = None) -> DataFrame:
    """``(id, text, label)`` from Parquet; the position in the file is the id, codes become names."""
    df = spark.read.parquet(path)
    value = F.col(label)
    if names is not None:
        value = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])[value]
    rows = numbered(placed(df), source_rows=df.count())
    return rows.select(F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("id"), "text", value.alias("label"))


def footer_label_names(path: str, feature: str) -> dict[int, str]:
    """Label names a Parquet file keeps in its own metadata. Reads the footer only."""
    import pyarrow.parquet as pq

    info = json.loads(pq.read_schema(path).metadata[b"huggingface"])
    return dict(enumerate(info["info"]["features"][feature]["names"]))


def json_messages(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """``(id, text, label)`` from (gzipped) JSON lines that carry their own id."""
    rows = spark.read.schema("id string, text string, label string").json(path)
    return rows.select(F.concat(F.lit(prefix), "id").alias("id"), "text", "label")


def suite_cases(spark: SparkSession, pattern: str, translations: str | None = None) -> DataFrame:
    """Search cases, one JSON file each: ``(repo, name, query, translated, matches)``."""
    schema = ("query string, keywords array<string>, matches array<struct<file string, start_line int, "
              "end_line int, symbol string, reason string>>")
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_p", F.col("_metadata.file_path"))
    parts = F.split("_p", "/")
    cases = raw.select(
        F.element_at(parts, -2).alias("repo"), F.regexp_extract("_p", "query_([^/]*)\\.json$", 1).alias("name"), "query", "matches"
    )
    if translations is None:
        return cases.withColumn("translated", F.lit(None).cast("string"))
    words = spark.read.text(translations, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "translated"))
    return cases.join(words, "name", "left")


def case_regions(cases: DataFrame) -> DataFrame:
    m = cases.select(F.concat_ws("__", "repo", "name").alias("query_id"), F.explode("matches").alias("m"))
    return m.select("query_id", F.col("m.file").alias("doc_id"), F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line"))


TOOL_SCHEMA = (
    "hits array<struct<path string, content_score double, name_score double, confidence double, lines_seen bigint, truncated boolean, "
    "ranges array<struct<start int, end int, p double, snippet string>>>>, query string, root string, rounds int, threshold double, "
    "wall_s double, stats struct<input_tokens bigint, api_ms bigint>, error string"
)


def tool_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Stored answers of an outside search tool, one JSON file per case, keyed by file name."""
    raw = spark.read.schema(TOOL_SCHEMA).option("multiLine", True).json(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)\\.json$", 1)
    hits = F.transform("hits", lambda h: h.withField("path", tx.forward_slashes(h["path"])))
    return raw.select(name.alias("query_id"), hits.alias("hits"), "wall_s", F.col("stats.input_tokens").alias("input_tokens"))


def tool_ranges(results: DataFrame) -> DataFrame:
    """Long ranges (query_id, doc_id, pos, start_line, end_line, p) of all hits."""
    h = results.select("query_id", F.explode("hits").alias("h")).select("query_id", F.col("h.path").alias("doc_id"), F.posexplode("h.ranges").alias("pos", "r"))
    return h.select("query_id", "doc_id", "pos", F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"), F.col("r.p").alias("p"))


def precomputed_scores(spark: SparkSession, path: str) -> DataFrame:
    """A stored score document ``{scores: {query: {chunk: score}}}`` as long rows."""
    raw = spark.read.schema("scores map<string, map<string, double>>").option("multiLine", True).json(path)
    per = raw.select(F.explode("scores").alias("query_id", "m"))
    return per.select("query_id", F.explode("m").alias("chunk_id", "score")).withColumn("chunk_id", F.col("chunk_id").cast("bigint"))
