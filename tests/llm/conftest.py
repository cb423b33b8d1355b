import duckdb
import pytest
from llm_checks import DOCS, HARD

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows; a column whose name clashes with outputs."""
    return spark.createDataFrame(HARD, DOCS).selectExpr(
        "*", "cast(1 as bigint) as n_chars", "'x' as node", "'y' as n_words", "'z' as matches", "1 as n_lines", "'k' as key", "'q' as _key")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con
