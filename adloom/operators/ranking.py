"""Global order without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.workspace import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_ordered(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Write ``df`` range-partitioned and sorted by ``key``, with ``part`` and ``row``.

    All rows of part n come before all rows of part n+1. The table is written so that
    every later use sees the same range bounds. Rows must be distinct on ``key``, or a
    heavy key would fill one part.
    """
    keys = [key] if isinstance(key, str) else key
    ordered = (
        df.repartitionByRange(_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return materialize(
        ordered.withColumn("part", F.shiftright("_at", _ROW_BITS).cast("int"))
        .withColumn("row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_at"),
        name,
    )


def running_before(totals: DataFrame, order: str, value: str) -> DataFrame:
    """Add ``<value>_before``, the sum over all earlier parts.

    ``totals`` has one row per part, so it is small enough for one window.
    """
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(
        f"{value}_before", F.coalesce(F.sum(value).over(earlier), F.lit(0))
    )


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct values of ``key`` numbered 0..n-1 in ascending order."""
    return _numbered(range_ordered(df.select(key).where(F.col(key).isNotNull()).distinct(), key, "dense"), key, name)


def row_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Every row's ``key`` numbered 0..n-1 in ascending order, nulls first.

    Rows that share a key are told apart by their place, so a frequent key spans as many
    parts as its rows need.
    """
    placed = df.select(key, F.monotonically_increasing_id().alias("_place"))
    return _numbered(range_ordered(placed, [key, "_place"], "rows"), key, name)


def _numbered(ordered: DataFrame, key: str, name: str) -> DataFrame:
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = running_before(sizes, "part", "size").drop("size")
    return ordered.join(F.broadcast(starts), "part").select(
        key, (F.col("size_before") + F.col("row")).alias(name)
    )
