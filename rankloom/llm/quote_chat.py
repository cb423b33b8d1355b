"""Chat formatting by quotation linking.

A line that begins with ``>`` marks is quoted; the number of marks is its level. Lines are normalised (marks
off, lower case, white space to one space); neighbouring lines of one level without a blank line between them are
a passage. What is hashed of a passage are its units: every line, every sentence, the whole passage, and every run
of ``WORDS`` words, so that a quote is found after it was wrapped at another width, and a part of a line or passage
as well. Units of the quoted passages of every level are joined to the units of own passages of earlier messages
of the same conversation. The shallowest level with a match decides: a message answers the message that holds most
distinct units of that level, the latest of those that hold equally many; without a match it answers the message
before it. Of a unit that several messages hold, only the latest before the quote counts. Quoted lines are taken
out of the text.

Reply order: a message that answers another than the one before it opens a branch there; messages that follow
without a quote stay in the branch. ``reply_path`` lists the turns to sort by: branches stand right after the
message that they answer, in the order of their opening. Sorting a conversation by it gives the conversation in
reply order.

Scale: one row for each message throughout. Units of quoting messages decide which units of others go further (two
semi joins, by conversation and by unit); of a unit that many messages hold, only the latest before each quote is
linked, by a running maximum and not by pairs. Only (conversation, turn) keys, no texts, are sorted for each
conversation. Paths of nested branches double their reach in every round.

Defined results: a null text is an empty message; equal rows are one message, and messages with the same turn
are ordered by role and a hash of the text; a null conversation or turn is a key like any other, null turns first; an empty
message stays with an empty text; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.tables import written

MARK = r"^[ \t]*>[ \t>]*"
WORDS = 5
QUOTED, BLANKS, SENTENCE = re.compile(MARK), re.compile(r"[\x00-\x20]+"), re.compile(r"(?<=[.!?]) ")


def _level(line: Column) -> Column:
    """Number of quote marks before the line's text; 0 for an own line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), r"[^>]", ""))


def passages(text: str) -> Iterator[tuple[int, list[str]]]:
    """(level, normalised lines) of every passage of a message."""
    level, held = 0, []
    for raw in text.split("\n"):
        mark = QUOTED.match(raw)
        own = mark[0].count(">") if mark else 0
        line = BLANKS.sub(" ", raw[mark.end():] if mark else raw).strip(" ").lower()
        if held and (own != level or not line):
            yield level, held
            held = []
        level = own
        if line:
            held.append(line)
    if held:
        yield level, held


def units(lines: list[str]) -> set[str]:
    """What is hashed of a passage: lines, sentences, the whole, and runs of WORDS words."""
    whole = " ".join(lines)
    words = whole.split(" ")
    return {whole, *lines, *SENTENCE.split(whole), *(" ".join(words[k:k + WORDS]) for k in range(len(words) - WORDS + 1))}


def _units(rows: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, place, level, key): the distinct units of the quoted or of the own passages of each message."""
    picked = rows.select("conv_id", "place", "text")
    schema = T.StructType([picked.schema["conv_id"], picked.schema["place"], T.StructField("level", T.IntegerType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, levels, keys = [], [], []

            def out():
                taken = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(levels, pa.int32()),
                                                   pa.array(keys, pa.uint64()).view(pa.int64())], names=["conv_id", "place", "level", "key"])

            for k, text in enumerate(batch.column(2).to_pylist()):
                found = {(level, xxhash.xxh3_64_intdigest(u)) for level, lines in passages(text) if (level > 0) == quoted for u in units(lines)}
                for level, key in found:
                    at.append(k)
                    levels.append(level)
                    keys.append(key)
                if len(at) > 200_000:
                    yield out()
                    at, levels, keys = [], [], []
            yield out()

    return picked.mapInArrow(run, schema)


def messages(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, place (turn, tie) as a sortable struct, text, own text, number of quoted lines."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    lines = F.split("text", "\n", -1)
    split = rows.select("*", F.transform(lines, lambda x: F.struct(_level(x).alias("level"), x.alias("raw"))).alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n")
    return split.select(
        "conv_id", "turn", "role", F.struct("turn", "role", F.xxhash64("text").alias("tie")).alias("place"),
        "text", F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("content"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))


def replies(rows: DataFrame) -> DataFrame:
    """(conv_id, place, answers): the place of the message that each quoting message answers."""
    quoted = written(_units(rows.where("n_quoted > 0"), quoted=True))
    asking = quoted.select(F.col("conv_id").alias("_c")).distinct()
    asked = rows.join(asking, rows["conv_id"].eqNullSafe(asking["_c"]), "left_semi")
    wanted = quoted.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).distinct()
    own = _units(asked, quoted=False)
    held = own.join(wanted, own["conv_id"].eqNullSafe(wanted["_c"]) & (own["key"] == wanted["_k"]), "left_semi")
    before = Window.partitionBy("conv_id", "key").orderBy("place", "asks").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.select("conv_id", "key", "place", "level", F.lit(1).alias("asks")).union(quoted.select("conv_id", "key", "place", "level", F.lit(0).alias("asks")))
    # At one place the question comes first, so a message never answers itself.
    found = both.withColumn("origin", F.max(F.when(F.col("asks") == 1, F.col("place"))).over(before)).where("asks = 0 and origin is not null")
    votes = found.groupBy("conv_id", "place", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("conv_id", "place").agg(F.max(F.struct(-F.col("level"), "n", "origin")).alias("top")).select(
        "conv_id", "place", F.col("top.origin").alias("answers"))


def reply_order(conversations: DataFrame, **names: str) -> DataFrame:
    """conv_id, turn, role, content, reply_to (turn), quotes (lines linked or not), reply_path."""
    rows = messages(conversations, **names)
    linked = written(replies(rows)).withColumnsRenamed({"conv_id": "_c", "place": "_p"})
    keys = rows.select("conv_id", "place")
    keys = keys.join(linked, keys["conv_id"].eqNullSafe(linked["_c"]) & (keys["place"] == linked["_p"]), "left").select("conv_id", "place", "answers")
    turn_order = Window.partitionBy("conv_id").orderBy("place")
    chain = keys.withColumn("previous", F.lag("place").over(turn_order)).withColumn(
        "opens", F.coalesce(F.col("answers") != F.col("previous"), F.lit(False))).withColumn(
        "branch", F.max(F.when(F.col("opens"), F.col("place"))).over(turn_order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = written(chain.select("conv_id", "place", "branch", "opens", F.coalesce("answers", "previous").alias("parent")))
    paths = _branch_paths(chain).withColumnsRenamed({"conv_id": "_c", "branch": "_b"})
    placed = chain.join(paths, chain["conv_id"].eqNullSafe(paths["_c"]) & (chain["branch"] == paths["_b"]), "left").select(
        F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("parent.turn").alias("reply_to"),
        F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("place.turn")).alias("reply_path"))
    return rows.join(placed, rows["conv_id"].eqNullSafe(placed["_c"]) & (rows["place"] == placed["_p"])).select(
        "conv_id", "turn", "role", "content", "reply_to",
        "n_quoted", "reply_path")


def _branch_paths(chain: DataFrame) -> DataFrame:
    """(conv_id, branch, path): the turns to sort a branch's messages behind.

    Each branch knows the branch above it; in every round it puts that one's path before its own and goes on to
    where that one points, so nesting of depth n takes log2(n) rounds.
    """
    opened = chain.where("opens").select("conv_id", "branch", "parent")
    holder = chain.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("branch").alias("above"))
    paths = written(opened.join(holder, opened["conv_id"].eqNullSafe(holder["_c"]) & (opened["parent"] == holder["_p"])).select(
        "conv_id", "branch", "above", F.array("parent.turn", "branch.turn").alias("path")))
    while not paths.where("above is not null").isEmpty():
        up = paths.withColumnsRenamed({"conv_id": "_c", "branch": "_b", "above": "_above", "path": "_path"})
        paths = written(paths.join(up, paths["conv_id"].eqNullSafe(up["_c"]) & (paths["above"] == up["_b"]), "left").select(
            "conv_id", "branch", F.col("_above").alias("above"),
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    return paths.select("conv_id", "branch", "path")


def formatted(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), content, F.lit("\n"))


def query(conversations: DataFrame) -> DataFrame:
    return reply_order(conversations.select("conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", "role", "reply_to", "n_quoted", F.array_join(F.transform("reply_path", lambda t: t.cast("string")), ".").alias("reply_path"),
        formatted(F.col("role"), F.col("content")).alias("formatted"))


SQL = r"""
WITH RECURSIVE base AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
msgs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS k FROM base),
lines AS (
  SELECT conv_id, k, u.i, u.l,
    length(regexp_replace(regexp_extract(u.l, '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level,
    lower(trim(regexp_replace(regexp_replace(u.l, '^[ \t]*>[ \t>]*', ''), '[\x00-\x20]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT conv_id, k, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {'l': l, 'i': i})) AS u FROM msgs)),
breaks AS (SELECT *, coalesce(line = '' OR lag(line) OVER w = '' OR level <> lag(level) OVER w, true) AS new_
           FROM lines WINDOW w AS (PARTITION BY conv_id, k ORDER BY i)),
numbered AS (SELECT *, sum(new_::int) OVER (PARTITION BY conv_id, k ORDER BY i) AS passage FROM breaks),
passages AS (SELECT conv_id, k, level, passage, string_agg(line, ' ' ORDER BY i) AS whole, list(line) AS parts
             FROM numbered WHERE line <> '' GROUP BY ALL),
worded AS (SELECT *, string_split(whole, ' ') AS words FROM passages),
units AS (
  SELECT conv_id, k, level, whole AS unit FROM worded
  UNION SELECT conv_id, k, level, unnest(parts) FROM worded
  UNION SELECT conv_id, k, level, unnest(string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM worded
  UNION SELECT conv_id, k, level, array_to_string(words[j:j + 4], ' ')
        FROM (SELECT *, unnest(range(1, len(words) - 3)) AS j FROM worded WHERE len(words) > 4)),
origin AS (SELECT q.conv_id, q.k, q.level, q.unit, max(o.k) AS o FROM units q JOIN units o
           ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.unit = o.unit AND o.level = 0 AND o.k < q.k WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT conv_id, k, level, o, count(*) AS n FROM origin GROUP BY ALL),
answers AS (SELECT conv_id, k, o FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY level, n DESC, o DESC) = 1),
chain AS (
  SELECT m.conv_id, m.k, m.turn, coalesce(a.o, nullif(m.k - 1, 0)) AS parent, coalesce(a.o <> m.k - 1, false) AS opens
  FROM msgs m LEFT JOIN answers a ON m.conv_id IS NOT DISTINCT FROM a.conv_id AND m.k = a.k),
branches AS (SELECT *, max(CASE WHEN opens THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS branch FROM chain),
paths AS (
  SELECT b.conv_id, b.k AS branch, [p.turn, b.turn] AS path FROM branches b
    JOIN branches p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.k = b.parent WHERE b.opens AND p.branch IS NULL
  UNION ALL
  SELECT b.conv_id, b.k, list_concat(up.path, [p.turn, b.turn]) FROM branches b
    JOIN branches p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.k = b.parent
    JOIN paths up ON up.conv_id IS NOT DISTINCT FROM b.conv_id AND up.branch = p.branch WHERE b.opens),
content AS (
  SELECT conv_id, k, count(*) FILTER (level > 0) AS n_quoted,
    regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS content
  FROM lines GROUP BY conv_id, k)
SELECT m.conv_id, m.turn, m.role, parent.turn AS reply_to, c.n_quoted,
  coalesce(array_to_string(list_concat(coalesce(p.path, []), [m.turn]), '.'), '') AS reply_path,
  '<|' || coalesce(m.role, '') || '|>' || chr(10) || c.content || chr(10) AS formatted
FROM msgs m JOIN branches b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.k = b.k
JOIN content c ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.k = c.k
LEFT JOIN msgs parent ON parent.conv_id IS NOT DISTINCT FROM m.conv_id AND parent.k = b.parent
LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.branch = b.branch
"""
