"""Instances and their feature tokens: explode, count, filter, sample, split, batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.columns import sample_bucket
from adloom.operators.lookup import lookup_join
from adloom.operators.ranking import row_index

_ROW_BITS = 33


def explode_tokens(instances: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per feature occurrence; ``keep_empty`` keeps instances without features."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return instances.select(
        "instance_id", "shows", "clicks", "label", explode("feats").alias("pos", "f")
    ).select("instance_id", "pos", "shows", "clicks", "label", "f.sign", "f.slot")


def feature_stat(tokens: DataFrame) -> DataFrame:
    """Shows and clicks per feature; a token repeated in an instance counts again."""
    return tokens.groupBy("sign").agg(
        F.sum("shows").alias("show_sum"), F.sum("clicks").alias("click_sum")
    )


def feature_freq(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("sign").agg(F.count(F.lit(1)).alias("freq"))


def frequent_features(stat: DataFrame, minimum: int, column: str = "show_sum") -> DataFrame:
    """Distinct signs whose ``column`` reaches ``minimum``."""
    return stat.where(F.col(column) >= minimum).select("sign").distinct()


def filter_instances(instances: DataFrame, keep: DataFrame) -> DataFrame:
    """Drop features outside ``keep``, then instances left without any.

    Regrouping gathers no more than one input row held. A ``line_id`` is passed on.
    """
    columns = ["instance_id", "shows", "clicks", "label", *[c for c in instances.columns if c == "line_id"]]
    # Rows are told apart by their place in the input: ids of log lines may repeat.
    placed = instances.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", *columns, F.posexplode("feats").alias("pos", "f")
    )
    tokens = placed.select("_row", *columns, "pos", "f.sign", "f.slot")
    kept = lookup_join(tokens, keep, "sign", "left_semi")
    # Array sort is by pos first, which restores the order of the line.
    feats = F.array_sort(F.collect_list(F.struct("pos", "sign", "slot")))
    return (
        kept.groupBy("_row", *columns)
        .agg(feats.alias("feats"))
        .drop("_row")
        .withColumn(
            "feats",
            F.transform(
                "feats", lambda f: F.struct(f["sign"].alias("sign"), f["slot"].alias("slot"))
            ),
        )
    )


def count_instances(instances: DataFrame) -> DataFrame:
    return instances.agg(F.count(F.lit(1)).alias("n"))


def whole_parts(rate: float) -> int:
    """The number of parts of which one makes up ``rate``."""
    parts = round(1 / rate)
    if abs(parts * rate - 1) > 1e-9:
        raise ValueError(f"rotating parts need a rate of 1/n, not {rate}; draw with mode='bernoulli'")
    return parts


def sample_instances(
    instances: DataFrame, rate: float, seed: int = 0, mode: str = "rotate"
) -> DataFrame:
    """A share ``rate`` of the instances.

    ``rotate`` splits instances into 1/rate fixed parts and returns part ``seed``
    modulo their number, so consecutive seeds visit every instance; ``bernoulli``
    draws each row independently.
    """
    if mode == "bernoulli":
        return instances.sample(rate, seed=seed)
    buckets = whole_parts(rate)
    return instances.where(
        sample_bucket(F.col("instance_id"), buckets) == seed % buckets
    )


def is_eval(instance_id: Column, mod: int = 10, rem: int = 0) -> Column:
    return F.pmod(instance_id, F.lit(mod)) == rem


def split_train_eval(
    instances: DataFrame, mod: int = 10, rem: int = 0
) -> tuple[DataFrame, DataFrame]:
    held_out = is_eval(F.col("instance_id"), mod, rem)
    return instances.where(~held_out), instances.where(held_out)


def shuffle_instances(
    instances: DataFrame, seed: int, partitions: int | None = None
) -> DataFrame:
    """Rows placed and ordered by a seeded hash; the same seed gives the same order."""
    n = partitions or int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("instance_id", F.lit(seed))
    return instances.repartition(n, order).sortWithinPartitions(order, "instance_id")


def assign_batches(instances: DataFrame, size: int) -> DataFrame:
    """Consecutive fixed-size batches in ``instance_id`` order; the last one is short.

    Rows that share an id, or have none, are rows of their own.
    """
    index = row_index(instances, "instance_id", "at")
    return index.select(
        "instance_id", F.floor(F.col("at") / size).alias("batch")
    )


def local_batches(instances: DataFrame, size: int) -> DataFrame:
    """Fixed-size batches cut inside each partition as it stands, without a shuffle."""
    at = F.monotonically_increasing_id()
    row = at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return instances.withColumn(
        "partition", F.shiftright(at, _ROW_BITS).cast("int")
    ).withColumn("batch", F.floor(row / size))
