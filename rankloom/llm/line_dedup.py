"""Line dedup by site-relative frequency.

A line's frequency on a site is the share of the site's pages that hold it; pages with equal text count once, so
copies of a page do not make its lines boilerplate. Lines above the boilerplate ratio are dropped from all pages
of that site. The ratio lies in the gap between boilerplate and lines that recur by chance. Lines are compared without white space at their ends; lines without a
word are neither counted nor dropped.

Scale: each page sends its distinct lines once, as hashes with the hash of its text. They are made distinct by all
three, so neither a site with a third of all pages nor a line on all of them is hot, and counted with a combiner. A site has at most
(mean lines of a page) / ratio lines above the ratio; they travel as one small array for each site. The join
with them leaves the text where it is while the table is under Spark's broadcast threshold; beyond it the join
is shuffled and skewed sites are split.

Defined results: a null text stays null with zero lines; an empty text stays empty; a null site is a site of
its own; repeated rows and null texts count as one page each site; a table of one page loses nothing (``min_pages``); extra columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import written

RATIO = 0.05
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def site_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each site that has such lines: site, array of line keys ``_drop``."""
    pages = docs.select(F.col(site).alias("_site"), F.col(text).alias("_text"), F.xxhash64(text).alias("_page"))
    total = pages.select("_site", "_page").distinct().groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), _has_word), _key))
    seen = (
        pages.select("_site", "_page", F.explode(keys).alias("_key")).distinct()
        .groupBy("_site", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    )
    return (
        seen.join(total, seen["_site"].eqNullSafe(total["_site"]))
        .where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
        .groupBy(seen["_site"]).agg(F.collect_set("_key").alias("_drop"))
    )


def drop_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the lines dropped, plus n_lines and n_dropped (lines with a word)."""
    found = written(site_boilerplate(docs, text, site, ratio, min_pages))
    plain = docs.drop("n_lines", "n_dropped", "_site", "_drop", "_all", "_left")
    joined = plain.join(found, plain[site].eqNullSafe(found["_site"]), "left")
    split = joined.select(*[plain[c] for c in plain.columns], "_drop", _lines(plain[text]).alias("_all"))
    stays = F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(
        F.filter("_all", lambda x: ~_has_word(x) | ~F.array_contains(F.col("_drop"), _key(x))))
    left = split.select("*", stays.alias("_left"))
    lines = F.coalesce(F.size(F.filter("_all", _has_word)), F.lit(0)).cast("long")
    dropped = F.coalesce(F.size("_all") - F.size("_left"), F.lit(0)).cast("long")
    out = [F.array_join("_left", "\n").alias(text) if c == text else F.col(c) for c in plain.columns]
    return left.select(*out, F.when(F.col("_all").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"),
                       F.when(F.col("_all").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"))


def query(docs: DataFrame) -> DataFrame:
    return drop_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_dropped")


_SQL_PAGES = r"""
pages_ AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
lines AS (
  SELECT row_id, source, u.i, u.l, regexp_replace(u.l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k,
    regexp_matches(u.l, '[^\x20\x09-\x0D]') AS w
  FROM (SELECT row_id, source, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {'l': l, 'i': i})) AS u
        FROM pages_)),
seen AS (SELECT l.source, k, count(DISTINCT p.text) AS n FROM lines l JOIN pages_ p USING (row_id) WHERE w GROUP BY l.source, k),
total AS (SELECT source, count(DISTINCT text) + coalesce(max((text IS NULL)::int), 0) AS pages FROM documents GROUP BY source),
boilerplate AS (
  SELECT s.source, s.k FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= 3 AND s.n > 0.05::DOUBLE * t.pages),
marked AS (
  SELECT l.*, w AND b.k IS NOT NULL AS gone
  FROM lines l LEFT JOIN boilerplate b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k),
built AS (
  SELECT row_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
    count(*) FILTER (w) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM marked GROUP BY row_id)
"""
SQL = f"""
WITH {_SQL_PAGES}
SELECT p.doc_id, b.text, coalesce(b.n_lines, 0) AS n_lines, coalesce(b.n_dropped, 0) AS n_dropped
FROM pages_ p LEFT JOIN built b USING (row_id)
"""
