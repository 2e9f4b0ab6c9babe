"""Joins against a table that is unique on the key, safe for hot keys on the other side.

A lookup table is broadcast only after its size has been measured. Beyond the limit
the big side is shuffled, and the keys that hold more than 1/1024 of its rows (so at
most 1023 keys, whatever the data) are answered by a broadcast of just those keys
while their rows are scattered over all shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.workspace import materialize

# The driver holds every broadcast several times over, and loops send one per step.
BROADCAST_BYTES = 16 * 1024 * 1024
LEAST_SHARE = 1024
# Narrow rows that one task sorts or groups; more rows take more tasks.
PART_ROWS = 1 << 20

# From the name of a key column to a frame of its hot keys.
HotKeys = Callable[[str], DataFrame]


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.adloom.broadcastBytes", str(BROADCAST_BYTES)))


def _fixed_width(data_type: T.DataType) -> int:
    return 16 if isinstance(data_type, T.DecimalType) else 8


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Measure ``df``; ``rows`` is a known upper bound for tables of fixed row width."""
    variable = [
        f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.ArrayType))
    ]
    width = 16 + sum(_fixed_width(f.dataType) for f in df.schema.fields)
    if rows is not None and not variable:
        return rows * width <= broadcast_limit(df.sparkSession)
    sizes = [
        F.octet_length(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.size(f.name) * 8
        for f in variable
    ]
    measured = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(s.cast("long")).alias(f"s{i}") for i, s in enumerate(sizes)],
    ).first()
    total = measured["rows"] * width + sum(
        measured[f"s{i}"] or 0 for i in range(len(sizes))
    )
    return total <= broadcast_limit(df.sparkSession)


def enough_parts(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for ``rows``: the session's, doubled until none holds over ``PART_ROWS``."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while parts * PART_ROWS < rows:
        parts *= 2
    return parts


def hot_share(df: DataFrame) -> int:
    """A key is hot above one part in this many; fewer keys than this can be."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SHARE, partitions)


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """Keys that would outgrow a shuffle partition."""
    total, share = left.count(), hot_share(left)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    return materialize(counts.where(F.col("count") * share > total).select(key), "hot")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    right_rows: int | None = None,
    hot: HotKeys | None = None,
    colocated: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``left`` of any size and skew joined to ``right``, which is unique on ``key``.

    ``how`` is ``left``, ``inner`` or ``left_semi``. ``hot`` supplies hot keys found
    earlier when the same left side is joined again and again. Where both sides are shuffled,
    partitions follow the number of ``rows``, counted unless given: what a task sorts does not
    grow with the input. ``colocated`` rows lie together by the key and stay.
    """
    if fits_broadcast(right, right_rows):
        return left.join(F.broadcast(right), key, how)
    if not colocated and rows is None:
        rows = left.count()
    found = hot(key) if hot else hot_keys(left, key)
    parts = 0 if colocated else enough_parts(left.sparkSession, rows)
    if found.isEmpty():
        keyed = _shuffled(left.where(F.col(key).isNotNull()), right, key, how, parts)
        if how != "left":
            return keyed
        empty = F.broadcast(right.limit(0))  # rows without a key stay where they are
        return keyed.unionByName(left.where(F.col(key).isNull()).join(empty, key, how))
    return _split_join(left, materialize(right, "lookup"), key, how, found, parts)


def _shuffled(left: DataFrame, right: DataFrame, key: str, how: str, parts: int) -> DataFrame:
    """Spark's own choice of partitions where the session's are enough, ``parts`` of them otherwise."""
    if parts > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(parts, key), right.repartition(parts, key)
    return left.join(right, key, how)


def _split_join(
    left: DataFrame, right: DataFrame, key: str, how: str, hot: DataFrame, parts: int
) -> DataFrame:
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    hot_left = left.join(F.broadcast(hot), key, "left_semi")
    spread_left = left.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti")
    if how == "left":  # rows without a key need no partner and must not shuffle together
        hot_left = hot_left.unionByName(left.where(F.col(key).isNull()))
    answered = hot_left.join(F.broadcast(hot_right), key, how)
    return answered.unionByName(_shuffled(spread_left, right, key, how, parts))
