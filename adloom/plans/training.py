"""What every training loop shares: laid-out tokens, history and stopping."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import sample_bucket
from adloom.operators.lookup import HotKeys, enough_parts, hot_share
from adloom.operators.tokens import whole_parts
from adloom.schema import HISTORY
from adloom.workspace import drop_bucketed, materialize, materialize_bucketed, release

if TYPE_CHECKING:
    from adloom.plans.packed import Packed

# An instance below this many tokens is never hot, however small the table.
LEAST_HOT = 10000

OnIteration = Callable[[int, DataFrame], None]


@dataclass
class Part:
    """Tokens to work on, how many instances they belong to, and their hot keys.

    ``colocated`` tokens lie together by instance: grouping on it needs no shuffle.
    """

    tokens: DataFrame
    n_instances: int
    hot: HotKeys
    colocated: bool = False
    table: str | None = None  # the catalog's name of colocated tokens
    packed: Packed | None = None  # the tokens again as arrays; ``tokens`` are then not written

    def release(self) -> None:
        """Delete the tokens, and the catalog's entry of colocated ones."""
        if self.packed:
            self.packed.release()
        elif self.table:
            drop_bucketed(self.tokens, self.table)
        else:
            release(self.tokens)


@dataclass
class Draw:
    """A fresh draw of fine buckets in every iteration, a share ``rate`` of them on average."""

    rate: float
    buckets: int
    seed: int

    def of(self, iteration: int) -> list[int]:
        rng = np.random.default_rng([self.seed, iteration])
        n = int(self.rate * self.buckets + rng.random())  # rounds so that the mean share is the rate
        return sorted(rng.choice(self.buckets, n, replace=False).tolist())


@dataclass
class TrainingTokens:
    """Tokens written once, one folder per sample bucket, so that a sampled iteration
    reads only its own share of the data."""

    tokens: DataFrame
    sizes: dict[int, int]  # instances per bucket
    drawn: Draw | None = None  # None: iterations rotate through the buckets
    table: str | None = None  # the catalog's name of a table bucketed by instance
    _hot: dict[str, DataFrame] = field(default_factory=dict)

    def all(self) -> Part:
        hot = lambda key: self._hot_table(key).select(key).distinct()
        return Part(self.tokens.drop("bucket"), sum(self.sizes.values()), hot, self.table is not None, self.table)

    def sample(self, iteration: int) -> Part:
        chosen = self.drawn.of(iteration) if self.drawn else [iteration % len(self.sizes)]
        in_bucket = F.col("bucket").isin(chosen)
        # A key that is hot in the part is hot in one of its buckets at least.
        hot = lambda key: self._hot_table(key).where(in_bucket).select(key).distinct()
        part = self.tokens.where(in_bucket).drop("bucket")
        return Part(part, sum(self.sizes[b] for b in chosen), hot, self.table is not None, self.table)

    def _hot_table(self, key: str) -> DataFrame:
        """Keys that outgrow a shuffle partition of their bucket, found once when first
        needed."""
        if key not in self._hot:
            per_key = self.tokens.groupBy("bucket", key).count()
            totals = self.tokens.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"))
            hot = per_key.join(F.broadcast(totals), "bucket").where(
                F.col("count") * hot_share(self.tokens) > F.col("total")
            )
            self._hot[key] = materialize(hot.select("bucket", key), "hot", lasting=True)
        return self._hot[key]

    def release(self) -> None:
        """Delete the laid-out tables; nothing may read a part of them afterwards."""
        if self.table:
            drop_bucketed(self.tokens, self.table)
        for table in (*([] if self.table else [self.tokens]), *self._hot.values()):
            release(table)


FINE_BUCKETS = 100  # least number of buckets to draw from


def lay_out(
    tokens: DataFrame, rate: float = 1.0, draw: int | None = None, colocate: bool = False
) -> TrainingTokens:
    """Write ``(instance_id, label, sign)`` by sample bucket.

    Iterations rotate through 1/``rate`` buckets, or, with a seed ``draw``, draw a share
    ``rate`` of many fine buckets anew each time; the rate is then any number up to 1.

    The rebalance hint gathers what belongs together, so that scores combine before
    their shuffle in every iteration, and splits whatever outgrows a task. ``colocate``
    fixes the place of an instance instead: the table is bucketed by it, and iterations need
    no shuffle on it at all. Instances above a task's fair share would make a bucket hot, so where
    there are any, the first layout is taken.
    """
    if draw is None:
        drawn, buckets = None, whole_parts(rate)
        bucket = sample_bucket(F.col("instance_id"), buckets)
    else:
        if not 0 < rate <= 1:
            raise ValueError(f"a rate lies above 0 and up to 1, not at {rate}")
        buckets = max(FINE_BUCKETS, math.ceil(10 / rate))
        drawn = Draw(rate, buckets, draw)
        bucket = F.pmod(F.xxhash64("instance_id"), F.lit(buckets)).cast("int")
    bucketed = tokens.select("instance_id", "label", "sign").withColumn("bucket", bucket)
    table = None
    most, total = instance_sizes(tokens) if colocate else (0, 0)
    if colocate and not has_hot_instance(tokens, most, total):
        n = enough_parts(tokens.sparkSession, total)
        written, table = materialize_bucketed(bucketed, "tokens", "instance_id", n, ("bucket",))
    else:
        together = "bucket" if buckets > 1 else "instance_id"
        bucketed = bucketed.hint("rebalance", together).sortWithinPartitions("bucket", "instance_id")
        written = materialize(bucketed, "tokens", ("bucket",), lasting=True)
    counts = (
        written.select("bucket", "instance_id").distinct().groupBy("bucket").count().collect()
    )
    found = {r["bucket"]: r["count"] for r in counts}
    return TrainingTokens(written, {b: found.get(b, 0) for b in range(buckets)}, drawn, table)


def instance_sizes(tokens: DataFrame) -> tuple[int, int]:
    """Tokens of the largest instance, and of all."""
    per_instance = tokens.groupBy("instance_id").count()
    found = per_instance.agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    return found["most"] or 0, found["total"] or 0


def has_hot_instance(tokens: DataFrame, most: int, total: int) -> bool:
    """Whether an instance of ``most`` out of ``total`` tokens is above a task's fair share."""
    return most * hot_share(tokens) > max(total, LEAST_HOT * hot_share(tokens))


@dataclass
class Fit:
    """A trained model: its weight frame and one history row per iteration."""

    weights: DataFrame
    history: DataFrame
    trace: DataFrame | None = None


def history_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, HISTORY)


def stalled(losses: list[float], tol: float | None, window: int = 10, least: int = 6) -> bool:
    """Average relative improvement over the last losses has fallen below ``tol``."""
    recent = losses[-(window + 1):]
    if tol is None or len(recent) < least or recent[-1] == 0:
        return False
    return (recent[0] - recent[-1]) / (len(recent) - 1) / abs(recent[-1]) < tol
