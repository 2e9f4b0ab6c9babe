"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, row number), so equal texts are neighbours
and a group of equal rows, however large, can be cut. A sample drawn with probability in proportion to size gives quantiles of that order; they cut it
into many narrow ranges. Every record is counted, and a range that turns out to hold more
than twice its share is sampled again and cut further, until none is left that can be cut.
Exact running sums inside the ranges then give each record its place on a line as long as
all bytes together, and eight (or any number of) equal pieces of that line are the shards.

A shard boundary that falls inside a group of equal texts moves to the group's nearer end
if the group is smaller than ``GROUP_SHARE`` of a shard. Larger groups are cut, which is
what keeps the shards even when one text holds a third of all rows.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import partitions, uniform
from adloom.workspace import materialize

#: Expected number of sampled keys for each range.
SAMPLE_PER_RANGE = 24
#: Ranges for each shard, at least; there are four for each shuffle partition otherwise.
RANGES_PER_SHARD = 16
#: A range is overfull above this many times the mean.
OVERFULL = 2.0
#: Groups of equal texts up to this part of a shard's bytes are not cut.
GROUP_SHARE = 0.05
#: Above all other numbers in a key.
LAST = (1 << 63) - 1


Key = tuple[int, int, int]


@dataclass
class Splitters:
    """Range bounds on (h, d, c): a record belongs to the first bound that is not below it."""

    keys: list[Key]

    def __post_init__(self):
        self.h = np.array([k[0] for k in self.keys], np.int64)

    def find(self, h: np.ndarray, d: np.ndarray, c: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        for at in np.flatnonzero(high > low):  # the hash is a bound itself
            low[at] = bisect_left(self.keys, (int(h[at]), int(d[at]), int(c[at])), int(low[at]), int(high[at]))
        return low.astype(np.int32)


def quantiles(keys: list[Key], n: int) -> set[Key]:
    """The n-1 inner quantiles of sampled keys."""
    keys = sorted(keys)
    return {keys[i * len(keys) // n] for i in range(1, n)} if keys else set()


def find_ranges(records: DataFrame, bounds: Splitters) -> DataFrame:
    """``records`` (h, d, c and more) with their ``range``."""

    @F.pandas_udf("int")
    def find(h: pd.Series, d: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(bounds.find(*(x.to_numpy(np.int64) for x in (h, d, c))))

    return records.withColumn("range", find("h", "d", "c"))


def _sample(records: DataFrame, rate: float, seed: int) -> list[Key]:
    """Keys drawn with probability size * rate; the caller bounds the expected number."""
    drawn = records.where(uniform("h", "d", "c", F.lit(seed)) < F.col("size") * rate)
    return [tuple(r) for r in drawn.select("h", "d", "c").collect()]


def _past_groups(records: DataFrame, keys: set[Key], uncut: float) -> Splitters:
    """Bounds that move to the end of their group (equal ``h``) if it is no larger than ``uncut``."""
    hashes = records.sparkSession.createDataFrame([(h,) for h in {k[0] for k in keys}], "h long")
    sizes = records.join(F.broadcast(hashes), "h").groupBy("h").agg(F.sum("size").alias("s"))  # one row for each bound
    small = {r["h"] for r in sizes.where(F.col("s") <= uncut).collect()}
    return Splitters(sorted({(k[0], LAST, LAST) if k[0] in small else k for k in keys}))


def split(records: DataFrame, n_ranges: int, uncut: float = 0.0) -> tuple[DataFrame, dict[int, int], Splitters]:
    """``records`` (h, d, c, size) with their ``range``, the size of each range, and the bounds.

    Groups of equal ``h`` up to a size of ``uncut`` stay in one range. Rows with one key are
    drawn together, so ``c`` should tell equal records apart. The driver holds the sample,
    the bounds and the sizes: numbers in proportion to ``n_ranges``.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return records.withColumn("range", F.lit(0)), {}, Splitters([])
    share = total / n_ranges
    bounds = _past_groups(records, quantiles(_sample(records, SAMPLE_PER_RANGE / share, 0), n_ranges), uncut)
    seed = 0
    while True:
        ranged = find_ranges(records, bounds)
        sizes = {r["range"]: r["s"] for r in ranged.groupBy("range").agg(F.sum("size").alias("s")).collect()}
        full = [r for r, s in sizes.items() if s > OVERFULL * share]
        if not full:
            return ranged, sizes, bounds
        seed += 1
        drawn = _sample(ranged.where(F.col("range").isin(full)), SAMPLE_PER_RANGE / share, seed)
        own = {r: [] for r in full}
        for key, r in zip(drawn, bounds.find(*np.array(drawn, np.int64).reshape(-1, 3).T).tolist()):
            own[r].append(key)
        cuts = set().union(*(quantiles(own[r], int(2 * sizes[r] / share) + 1) for r in full))
        cut = Splitters(sorted({*bounds.keys, *_past_groups(records, cuts, uncut).keys}))
        if len(cut.keys) == len(bounds.keys):  # what is left cannot be cut
            return ranged, sizes, bounds
        bounds = cut


def shard(documents: DataFrame, n_shards: int) -> DataFrame:
    """All ``documents`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Size is the text's UTF-8 bytes plus 1. Shards differ in bytes by no more than a
    document and the groups kept whole at their two ends. ``slot`` numbers a shard's
    records from 0 without gaps. A null text counts as empty in size and crc and groups
    with nulls; a null doc_id sorts first in its group; repeated rows are separate records and
    are cut like others; a text longer than a range is a range of its own; no rows give no rows. Extra columns are ignored.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
            F.monotonically_increasing_id().alias("c"),
        ),
        "sized",
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = max(RANGES_PER_SHARD * n_shards, 4 * partitions(spark))
    ranged, sizes, _ = split(records, ranges, GROUP_SHARE * total / n_shards)
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r, before))
        before += sizes[r]
    offsets = spark.createDataFrame(starts, "range int, range_start long")

    in_order = Window.partitionBy("range").orderBy("h", "d", "c")
    group = Window.partitionBy("range", "h")
    placed = (
        ranged.join(F.broadcast(offsets), "range")  # one row for each range
        .withColumn("upto", F.col("range_start") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(in_order))
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_end", F.max("upto").over(group))
    )
    whole = F.col("group_size") <= GROUP_SHARE * total / n_shards
    middle = F.when(whole, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    placed = materialize(
        placed.withColumn(
            "shard", F.least(F.floor(middle * n_shards / float(max(total, 1))), F.lit(n_shards - 1)).cast("int")
        ).select("doc_id", "size", "text_crc32", "range", "nth", "shard"),
        "placed",
    )
    # A shard's part of a range is an interval, so its first slot follows from small counts.
    pieces = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    so_far = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "shard", "range", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift")
    )
    return placed.join(F.broadcast(pieces), ["shard", "range"]).select(  # at most ranges + shards rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
