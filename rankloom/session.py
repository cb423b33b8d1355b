"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared_folder(spark: SparkSession) -> str:
    """The folder the session names (``spark.checkpoint.dir``), made the checkpoint folder if there is none yet.

    Only a local session without any checkpoint folder, as in tests, gets a temporary one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankloom-ckpt-"))
    return named or sc.getCheckpointDir()


SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table dealt over the cores by ``key``; a larger one as it lies.

    A file of a few megabytes is often one row group, which a single task would have to read and cut. Tables past
    ``SPREAD_BYTES`` have row groups for many tasks, and their texts stay in the scan. The rows are the same either way.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(shuffle_width(df.sparkSession), key) if size <= SPREAD_BYTES else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_048  # rows that a Python worker gets at once


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside give their Python workers at most ``BATCH_ROWS`` rows at once; a smaller setting of the session stays."""
    before = spark.conf.get(ARROW_ROWS)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by any number of plans, under ``schema`` if given.

    The planner knows the size of the files, so a small table is broadcast without a hint. Batches that go to Python on
    the way are bounded (``bounded_batches``), since a worker holds a whole one, and rows may be wide.
    """
    path = f"{_shared_folder(df.sparkSession).rstrip('/')}/rankloom-{uuid.uuid4().hex}"
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows_bound: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast hint only where the caller can prove the number of rows stays under ``limit``."""
    return F.broadcast(df) if rows_bound <= limit else df


def broadcast_checked(df: DataFrame, counted: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Broadcast hint after counting ``counted``, which has at least as many rows as ``df``.

    Counting stops just past the limit; beyond it the join is shuffled with skew splitting.
    """
    return broadcast_within(df, counted.limit(limit + 1).count(), limit)
