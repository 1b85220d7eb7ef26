"""Scans along a global order, without a window over the whole table.

Rows are range-partitioned and sorted by the order; a window inside each
partition does the scan, and one row a partition (its first or last value,
the only thing the driver sees) carries it across partition ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted ranges with their number; stored, so that every use sees the same ranges."""
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def _carried(df: DataFrame, rows: list[tuple], value_type: str, name: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(rows, f"_pid int, `{name}` {value_type}")
    return df.join(F.broadcast(table), "_pid", "left")  # one row a partition


def with_next(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the next larger value of ``column`` (distinct values; null after the last)."""
    ranged = _ranged(df, [column])
    heads = sorted((r["_pid"], r["v"]) for r in ranged.groupBy("_pid").agg(F.min(column).alias("v")).collect())
    follow = [(pid, head) for (pid, _), (_, head) in zip(heads, heads[1:])]
    w = Window.partitionBy("_pid").orderBy(column)
    return (_carried(ranged, follow, dict(df.dtypes)[column], "_head")
            .withColumn(out, F.coalesce(F.lead(column).over(w), F.col("_head"))).drop("_pid", "_head"))


def with_last_seen(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the last value of ``value`` that is not null, up to and with this row (null before any)."""
    ranged = _ranged(df, order)
    last = ranged.filter(F.col(value).isNotNull()).groupBy("_pid").agg(F.max_by(value, F.struct(*order)).alias("v"))
    tails = {r["_pid"]: r["v"] for r in last.collect()}
    pids = [r["_pid"] for r in ranged.select("_pid").distinct().collect()]
    carry, seen = [], None
    for pid in sorted(pids):
        if seen is not None:
            carry.append((pid, seen))
        seen = tails.get(pid, seen)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (_carried(ranged, carry, dict(df.dtypes)[value], "_tail")
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_tail"))).drop("_pid", "_tail"))
