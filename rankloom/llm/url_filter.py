"""URL filter: allow and block entries in one trie over reversed host labels and path segments.

The trie is walked label by label from the end of the host and then segment by segment through the path.
An entry fits its host and all subdomains if the path starts with the entry's path. Among the entries that
fit, the one with the most host labels wins, then the one with the longest path; an entry given both ways
blocks.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default
verdict; repeated rows are judged each on their own; extra columns pass through unless they bear the name
of an output column; an empty rule list gives every url the default.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRIE_ENTRIES = 200_000
OUTPUT = ("host", "path", "rule", "verdict")


class Entry(NamedTuple):
    verdict: str
    host: str
    path: str


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (ASCII letters lower-cased) and ``path``; both empty without ``://``."""
    df = df.drop("host", "path")
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumns({"host": host, "path": F.regexp_extract(text, pattern, 2)})


def build_trie(entries: list[Entry]) -> dict:
    """Nested dictionaries: host labels from the last on, then whole path segments, then the open last one."""
    root: dict = {"labels": {}, "path": None}
    for e in sorted(set(entries), key=lambda e: e.verdict == "block"):
        node = root
        for label in reversed(e.host.lower().split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "path": None})
        node["path"] = node["path"] or {"next": {}, "ends": {}, "sizes": []}
        step = node["path"]
        *whole, last = e.path.split("/")
        for segment in whole:
            step = step["next"].setdefault(segment, {"next": {}, "ends": {}, "sizes": []})
        step["ends"][last] = (e.host.lower() + e.path, e.verdict)
        step["sizes"] = sorted({*step["sizes"], len(last)}, reverse=True)
    return root


def _longest_path(step: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        ends = step["ends"]
        # Only lengths that some entry has are tried.
        best = next((ends[segment[:n]] for n in step["sizes"] if n <= len(segment) and segment[:n] in ends), best)
        step = step["next"].get(segment)
        if step is None:
            break
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(entry, verdict) of the longest match, or None."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        if node["path"]:
            best = _longest_path(node["path"], segments) or best
    return best


def filter_urls(df: DataFrame, entries: list[Entry], url: str = "url", default: str = "allow",
                max_trie: int = MAX_TRIE_ENTRIES) -> DataFrame:
    """Adds host, path, rule (null without a match) and verdict to every row.

    The trie is broadcast for up to ``max_trie`` entries. A longer list is cut into tries of that size, by
    host, whose best matches are compared; the rows are still read once for each trie and never shuffled.
    """
    for e in entries:
        if e.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {e.verdict!r}")
    ordered = sorted(set(entries))
    rows = with_parts(df.drop("rule", "verdict"), url)
    sc = df.sparkSession.sparkContext
    tries = [sc.broadcast(build_trie(ordered[k:k + max_trie])) for k in range(0, len(ordered), max_trie)]
    schema = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            found = []
            for h, p in zip(host, path, strict=True):
                hits = [x for x in (lookup(t.value, h, p) for t in tries) if x] if h else []
                found.append(max(hits, key=lambda x: (x[0].index("/"), len(x[0]), x[1] == "block"), default=None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x and x[0] for x in found], pa.string()),
                 pa.array([x[1] if x else default for x in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(judge, schema)


RULES = [
    Entry("allow", "com", "/"), Entry("block", "example.com", "/en/"), Entry("allow", "www.example.com", "/en/"),
    Entry("block", "net", "/es/"), Entry("block", "net", "/fr/"),
]


def query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), RULES).select("page_id", *OUTPUT)


SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
best AS (
  SELECT row_id, arg_max(r.host || r.path, length(r.host) * 100000 + length(r.path)) AS rule,
    arg_max(r.verdict, length(r.host) * 100000 + length(r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (row_id)
"""
