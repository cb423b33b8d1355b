"""Filter interaction audit: what each of five filters removes in every order of applying them.

Min-plus removal ranks. A document's failures are a row of a mask matrix (0 where it fails a filter, infinite where it
passes), an order of the filters is a row of the inverse permutation (the step at which each filter comes). Their
min-plus product is the step at which that order removes the document. Documents with the same mask and part are
removed alike, so the product is taken once for each of at most 32 masks of a part, and the counts of documents are
the weights that are scattered to (order, step).

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D holds any of
``#$%&*|``; E has the text of a smaller doc_id, anywhere in the table. Words are ``[^\\x20\\x09-\\x0D]+``.

Plan: one native scan of the texts to (doc_id, part, digest, four bits), written once. The first owner of each text is
a minimum with partial sums; it meets the rows on (digest, doc_id), which spreads the copies of one text over all
tasks. Everything behind the counts has 32 rows for a part at most.

Defined results: a null text is empty; a null source is the part ''; a null doc_id never fails E, makes no other row
fail it and has no labels; repeated rows count each, and rows that share doc_id and text do not fail E by each other;
of repeated label rows any 1 counts; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACES, MARKS, CAPITALS = "[\\x20\\x09-\\x0D]+", "[#$%&*|]", "[^A-Z]+"
STEPS = len(FILTERS)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that the text fails; ``text`` is not null."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, CAPITALS, ""))
    fails = {
        "A": lambda w: F.size(w) < 50,
        "B": lambda w: F.size(F.array_distinct(w)) * 100 < F.size(w) * 65,
        "C": lambda w: capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": lambda w: text.rlike(MARKS),
    }
    # The words are bound once, as the only element of an array.
    bits = lambda w: sum((F.when(f(w), _bit(c)).otherwise(0) for c, f in fails.items()), F.lit(0))
    return F.get(F.transform(F.array(words), bits), F.lit(0))


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: the bits of all five filters that it fails."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(plain, 256)).alias("key"), text_failures(plain).alias("bits")))
    owners = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    met = rows.join(owners.withColumn("own", F.lit(True)), ["key", "doc_id"], "left")
    copy = F.col("own").isNull() & F.col("doc_id").isNotNull()
    return met.select("doc_id", "part", (F.col("bits") + F.when(copy, _bit("E")).otherwise(0)).alias("mask"))


def weights(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic, with each mask."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("toxic"))
    return failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_ranks(groups: DataFrame) -> DataFrame:
    """``groups`` once for each order, with ``removed_at``: the min-plus product of its mask and the order's positions.

    A mask without failures keeps the infinite rank, here one past the last step.
    """
    positions = [F.struct(F.lit(o).alias("filter_order"), F.array(*[F.lit(o.index(c) + 1) for c in FILTERS]).alias("at")) for o in ORDERS]
    each = groups.withColumn("_o", F.explode(F.array(*positions)))
    costs = [F.when(F.col("mask").bitwiseAND(_bit(c)) != 0, F.get("_o.at", F.lit(i))) for i, c in enumerate(FILTERS)]
    return each.select(*groups.columns, F.col("_o.filter_order").alias("filter_order"), F.coalesce(F.least(*costs), F.lit(STEPS + 1)).alias("removed_at"))


def audit(groups: DataFrame) -> DataFrame:
    """One row for each part, order and step, with the weights scattered to it."""
    ranked = removal_ranks(groups)
    step, at = F.col("step"), F.col("removed_at")
    rows = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).withColumn(
        "filter", F.substring("filter_order", step, F.lit(1)))
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)")
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    fails = F.col("mask").bitwiseAND(bit) != 0
    cells = rows.groupBy("part", "filter_order", "step", "filter").agg(
        count(at > step)("kept"), count(at == step)("removed"), count(fails & (at < step))("redundant"),
        count(F.col("mask") == bit)("unique_fails"), count(at == step, "good")("good_lost"), count(at == step, "toxic")("toxic_lost"))
    shares = cells.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return cells.join(shares, ["part", "filter"]).drop("filter")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    groups = written(weights(failures(docs.select("doc_id", "text", "source")), labels))
    return audit(groups).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH plain AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM plain),
owners AS (SELECT text, min(doc_id) AS first FROM plain GROUP BY text),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM words JOIN owners USING (text) LEFT JOIN lab USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
cells AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails,
    contains(fails, filter_order[step]) AS hit,
    len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS before
  FROM sets, orders, range(1, 6) s(step)),
sums AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT hit AND NOT before) AS kept, sum(n) FILTER (hit AND NOT before) AS removed,
    sum(n) FILTER (hit AND before) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
    sum(good) FILTER (hit AND NOT before) AS good_lost, sum(toxic) FILTER (hit AND NOT before) AS toxic_lost
  FROM cells GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM sums
"""
