"""Row numbers and running sums inside groups, safe for a group that holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import DEFAULTS
from rankloom.session import cut_lineage, shuffle_width


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    source_rows: int | None = None,
    limit: int = DEFAULTS.single_window_rows,
) -> DataFrame:
    """Add ``rn`` and the running ``sums`` for each group of ``by`` in the given order.

    When the caller proves that at most ``limit`` rows can arrive (``source_rows``), one window
    does it. Otherwise rows are range-partitioned by group and order, so that even one group
    spreads over all partitions, each slice is numbered locally, and slice totals (one row per
    group and slice) supply the offsets. The slices are fixed by a checkpoint, so a lost
    executor cannot renumber them.
    """
    sums = sums or {}
    keyed = df.select("*", *[v.cast("long").alias(f"_v_{n}") for n, v in sums.items()])

    def window(parts):
        base = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        return base.orderBy(*order)

    def locally(frame, parts):
        w = window(parts)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        out = frame.withColumn("rn", F.row_number().over(w).cast("long"))
        for n in sums:
            out = out.withColumn(n, F.sum(f"_v_{n}").over(upto))
        return out

    drop = [f"_v_{n}" for n in sums]
    if source_rows is not None and source_rows <= limit:
        return locally(keyed, by).drop(*drop)

    width = max(shuffle_width(df.sparkSession), 2)
    spread = keyed.repartitionByRange(width, *[F.col(c) for c in by], *order)
    sliced = cut_lineage(spread.withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*by, "_slice").agg(
        F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_slice")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    out = locally(sliced, [*by, "_slice"]).join(offsets, [*by, "_slice"])
    out = out.withColumn("rn", F.col("rn") + F.col("_o"))
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"_o_{n}"))
    return out.drop("_slice", "_o", *drop, *[f"_o_{n}" for n in sums])
