"""Splitting documents into windows. All row-local array expressions: no shuffle, no Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config, DEFAULTS
from rankloom.functions.text import strip

HEADING_LINE = "^(#{1,4})\\s+(.*)$"


ID_BITS = 32
ID_SHIFT = 1 << ID_BITS


def chunk_key(doc_id: Column, ordinal: Column) -> Column:
    """One id for (document, ordinal); shifting it right by ``ID_BITS`` gives the document, negative ones too. An array
    has fewer than 2^31 members, so ordinals never reach the next document; a doc_id of 2^31 or more overflows and fails
    instead of colliding."""
    return doc_id * F.lit(1 << ID_BITS) + ordinal


FOLD_GROUP = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(items: Column, start: Column, out_type: str, step: Callable[[Column, Column], Column],
         last: Callable[[Column], Column] | None = None) -> Column:
    """Outputs of a walk over an array: ``step(state, item)`` gives a struct of the next ``state`` and an array ``out``.

    ``last(state)`` is an array of outputs behind the end. Outputs are gathered for each group of ``FOLD_GROUP`` items and
    the groups once more, since a single growing array would be copied at every item.
    """
    none = F.array().cast(f"array<{out_type}>")

    def walk(state, group):
        begin = F.struct(state.alias("state"), none.alias("out"))
        return F.aggregate(group, begin, lambda acc, x: let(step(acc["state"], x), lambda r: F.struct(
            r["state"].alias("state"), F.when(F.size(r["out"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], r["out"])).alias("out"))))

    def over(items):
        cuts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(FOLD_GROUP))
        groups = F.transform(cuts, lambda i: F.slice(items, i + 1, F.lit(FOLD_GROUP)))
        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        done = F.aggregate(groups, begin, lambda acc, g: let(walk(acc["state"], g), lambda r: F.struct(
            r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))))
        return let(done, lambda r: F.flatten(r["out"]) if last is None else F.concat(F.flatten(r["out"]), last(r["state"])))

    return let(items, over)


def _hard_cut(paragraph: Column, max_chars: int, step: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.length(paragraph) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(paragraph, i + 1, F.lit(max_chars)))


def window_text(text: Column, max_chars: int, overlap: int) -> Column:
    """Windows of at most about ``max_chars`` packed from paragraphs.

    A paragraph longer than a window is sliced with a stride of ``max_chars - overlap``;
    otherwise a full buffer is closed and its tail opens the next one when the tail is
    shorter than the paragraph that follows.
    """
    blank = F.lit("")
    none = F.array().cast("array<string>")

    def closed(buffer):
        return let(strip(buffer), lambda kept: F.when(F.length(kept) > 0, F.array(kept)).otherwise(none))

    def turn(state, out):
        return F.struct(state.alias("state"), out.alias("out"))

    def step(buffer, p):
        size = F.length(p)
        room = F.length(buffer) + size + 2 <= max_chars
        tail = F.substring(buffer, F.greatest(F.length(buffer) - overlap + 1, F.lit(1)), F.lit(overlap))
        reopened = F.when((F.length(tail) > 0) & (F.length(tail) < size), F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        grown = F.when(F.length(buffer) > 0, F.concat(buffer, F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(size > max_chars, turn(blank, F.concat(closed(buffer), _hard_cut(p, max_chars, max_chars - overlap))))
            .when(room, turn(grown, none))
            .otherwise(turn(reopened, closed(buffer)))
        )

    packed = fold(F.split(text, "\n{2,}"), blank, "string", step, closed)
    return (
        F.when(F.length(text) == 0, none)
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(packed)
    )


def document_chunks(docs: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``docs(doc_id, title, text)`` to ``chunks(chunk_id, doc_id, ordinal, title, body)``."""
    parts = docs.select(
        "doc_id",
        "title",
        F.posexplode(window_text(F.col("text"), cfg.chunk_max_chars, cfg.chunk_overlap_chars)).alias("ordinal", "body"),
    )
    return parts.select(
        chunk_key(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", "title", "body"
    )


def markdown_sections(raw: Column) -> Column:
    """Array of (heading, heading_path, body), one per heading plus the text above the first.

    The heading lines are walked once; the state holds the open headings, and a new heading
    closes every open one of its own level or deeper. Bodies are slices of the line array.
    """
    level_text = "array<struct<level:int,text:string>>"
    located = "struct<at:int,heading:string,path:string>"

    def step(chain, h):
        above = F.filter(chain, lambda o: o["level"] < h["level"])
        opened = F.array_append(above, F.struct(h["level"].alias("level"), h["text"].alias("text")))
        return let(opened, lambda now: F.struct(now.alias("state"), F.array(F.struct(
            h["at"].alias("at"), h["text"].alias("heading"), F.array_join(F.transform(now, lambda o: o["text"]), " > ").alias("path"))).alias("out")))

    def of_lines(lines):
        marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(HEADING_LINE))
        heads = F.transform(marked, lambda x: F.struct(
            x["at"].alias("at"), F.length(F.regexp_extract(x["line"], HEADING_LINE, 1)).alias("level"),
            strip(F.regexp_extract(x["line"], HEADING_LINE, 2)).alias("text")))
        top = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("heading"), F.lit("").alias("path"))).cast(f"array<{located}>")
        marks = F.concat(top, fold(heads, F.array().cast(level_text), located, step))
        return let(marks, lambda m: F.zip_with(m, _ends(m, F.size(lines)), section(lines)))

    def _ends(marks, n):
        return F.concat(F.transform(F.slice(marks, F.lit(2), F.greatest(F.size(marks) - 1, F.lit(0))), lambda m: m["at"]), F.array(n))

    def section(lines):
        return lambda m, end: F.struct(m["heading"].alias("heading"), m["path"].alias("path"), F.slice(lines, m["at"] + 2, end - m["at"] - 1).alias("body"))

    filled = lambda s: (F.length(s["heading"]) > 0) | (
        F.length(strip(F.array_join(s["body"], "\n"))) > 0
    )
    return F.filter(let(F.split(raw, "\r?\n"), of_lines), filled)


def merge_short_sections(sections: Column, min_chars: int) -> Column:
    """Join a section with too little text to the next one, keeping the earlier heading.

    The last section always stands on its own.
    """
    shape = "struct<heading:string,path:string,body:array<string>>"
    ready = "struct<heading:string,path:string,body:string>"
    nothing, none = F.lit(None).cast(shape), F.array().cast(f"array<{ready}>")

    def tidy(body):
        return strip(F.regexp_replace(F.array_join(body, "\n"), "\n{3,}", "\n\n"))

    def finished(whole, text):
        return F.array(F.struct(whole["heading"].alias("heading"), whole["path"].alias("path"), text.alias("body")))

    def joined(held, s):
        bridge = F.when(F.length(held["heading"]) > 0, F.concat(F.lit("## "), s["heading"])).otherwise(F.lit(""))
        return F.when(held.isNull(), s.cast(shape)).otherwise(F.struct(
            F.coalesce(F.nullif(held["heading"], F.lit("")), s["heading"]).alias("heading"),
            F.coalesce(F.nullif(held["path"], F.lit("")), s["path"]).alias("path"),
            F.concat(held["body"], F.array(bridge), s["body"]).alias("body"),
        ))

    def step(held, s):
        return let(joined(held, s), lambda whole: let(tidy(whole["body"]), lambda text: F.when(
            F.length(text) >= min_chars, F.struct(nothing.alias("state"), finished(whole, text).alias("out"))).otherwise(
            F.struct(whole.alias("state"), none.alias("out")))))

    def last(held):
        return F.when(held.isNull(), none).otherwise(finished(held, tidy(held["body"])))

    return fold(sections, nothing, ready, step, last)


def markdown_chunks(docs: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``docs(doc_id, text)`` of markdown to section windows with heading and heading path."""
    cut = docs.select("doc_id", markdown_sections(F.col("text")).alias("sections"))
    merged = cut.select("doc_id", merge_short_sections(F.col("sections"), cfg.chunk_min_chars).alias("sections"))
    windows = F.flatten(
        F.transform(
            F.col("sections"),
            lambda s: F.transform(
                window_text(s["body"], cfg.chunk_max_chars, cfg.chunk_overlap_chars),
                lambda w: F.struct(s["heading"].alias("heading"), s["path"].alias("heading_path"), w.alias("body")),
            ),
        )
    )
    return merged.select("doc_id", F.posexplode(windows).alias("ordinal", "w")).select(
        "doc_id", "ordinal", "w.heading", "w.heading_path", "w.body"
    )


def line_windows(docs: DataFrame, size: int) -> DataFrame:
    """``docs(doc_id, text)`` to windows of ``size`` lines with 1-based inclusive bounds; blank ones dropped."""
    text = F.regexp_replace(F.col("text"), "\r\n?", "\n")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size))
    cut = docs.select("doc_id", lines.alias("lines")).select(
        "doc_id", "lines", F.explode(starts).alias("at")
    )
    body = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n")
    return cut.select(
        "doc_id",
        (F.col("at") + 1).alias("start_line"),
        F.least(F.col("at") + size, F.size("lines")).alias("end_line"),
        body.alias("body"),
    ).where(F.length(strip(F.col("body"))) > 0)
