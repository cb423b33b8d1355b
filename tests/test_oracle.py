"""Every registered query against its SQL on the given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.plans.catalog import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if math.isnan(v) else float(v)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(REGISTRY)))
def test_same_rows(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "score"] and df.count() > 0


def test_only_learned_and_stemmed_queries_lack_sql():
    assert set(REGISTRY) - set(entry.oracle_sql()) == {"tfidf_lr", "emb_lr", "lsh_topk", "cells_topk", "lexical_stemmed_topk"}
