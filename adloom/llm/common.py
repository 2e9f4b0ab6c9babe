"""Small helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adloom.workspace import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def finished(table: DataFrame) -> None:
    """Have Spark drop the shuffle files of what has been written to ``table``.

    Spark removes them once the driver no longer holds the plan that made them, which a
    large heap may put off until the disks are full.
    """
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()


_held: list = [None, None]


def held(key, make: Callable | None = None):
    """What ``make`` gives, kept by a Python worker until it is asked for another key.

    Workers outlive their stage, and tables of a stage that is over would stay in all of
    them. So a worker holds one thing at a time, and hands freed memory back to the system.
    """
    if _held[0] != key:
        _held[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
        _held[:] = [key, make() if make else None]
    return _held[1]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``kept`` names, one of several equal ones.

    ``kept`` has a struct ``row`` of ``doc_id`` and ``h``, the xxhash64 of the text.
    """
    key, nth, id_, least = (unused(documents, f"_{c}") for c in ("key", "nth", "id", "least"))
    kept = kept.select(F.col("row.doc_id").alias(id_), F.col("row.h").alias(least))
    keyed = documents.withColumn(key, F.xxhash64("text"))
    found = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(least)))
    twins = Window.partitionBy(id_, least).orderBy(F.lit(0))
    single = found.withColumn(nth, F.row_number().over(twins)).where(F.col(nth) == 1)
    return single.select(*[single[f"`{c}`"] for c in documents.columns])


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of key columns in which a null matches a null."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def ordered_rows(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` in one global order, written once, with ``part`` and ``row``.

    All rows of part n come before all rows of part n+1; ``row`` counts from 0 within a
    part. Range bounds are drawn over all of ``keys``, so one frequent leading key spans
    as many parts as its rows need. The table is written so that every later use, also
    after the loss of an executor, sees the same bounds and numbers.
    """
    at = F.monotonically_increasing_id()
    return materialize(
        df.repartitionByRange(partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", at)
        .withColumn("part", F.shiftright("_at", ROW_BITS).cast("int"))
        .withColumn("row", F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_at"),
        name,
    )


def uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on ``columns`` alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


class Memory:
    """Results of a pure function, for as many keys as two generations hold.

    When the young generation is full it becomes the old one, and the old one is dropped;
    what is asked for again moves up. Frequent keys stay, and the size is bounded.
    """

    def __init__(self, function, size: int, longest: int):
        self.function, self.size, self.longest = function, size, longest
        self.young, self.old = {}, {}

    def one(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.function(key)
            if len(key) <= self.longest:
                if len(self.young) >= self.size:
                    self.young, self.old = {}, self.young
                self.young[key] = found
        return found

    def all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        return list(map(self.one, keys)) if None in found else found
