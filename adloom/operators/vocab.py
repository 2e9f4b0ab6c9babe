"""Slot vocabularies, index encoding, multi-hot rows and pooled embeddings.

The vocabulary holds at most V features (a parameter, 10000 by default), so every
frame derived from it alone is bounded by V and may be broadcast or windowed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.columns import factor
from adloom.operators.factor import whole_vectors
from adloom.operators.lookup import HotKeys, lookup_join
from adloom.workspace import materialize

VOCAB_SIZE = 10000  # fixed value
MOVING_DECAY = 0.999  # fixed value
# Moving averages start from mean 0 and variance 0.1.
START_MEAN, START_VARIANCE = 0.0, 0.1


def train_dictionary(tokens: DataFrame) -> DataFrame:
    """``(sign, slot, pv)``: occurrences and the slot of the first occurrence.

    Instance and position are packed into one number, which keeps the aggregate on
    fixed-width buffers and out of a sort.
    """
    first_seen = F.col("instance_id").cast("decimal(20,0)") * F.lit(1 << 31).cast(
        "decimal(10,0)"
    ) + F.col("pos").cast("decimal(10,0)")
    return tokens.groupBy("sign").agg(
        F.min_by("slot", first_seen).alias("slot"), F.count(F.lit(1)).alias("pv")
    )


def top_features(dictionary: DataFrame, v: int = VOCAB_SIZE) -> DataFrame:
    """The V most frequent features; equal counts go by ascending sign."""
    return dictionary.orderBy(F.desc("pv"), F.asc("sign")).limit(v)


def build_vocabulary(
    dictionary: DataFrame, v: int = VOCAB_SIZE
) -> tuple[DataFrame, DataFrame]:
    """``vocab (sign, slot, pv, slot_idx, feat_idx)`` and ``slots (slot, slot_idx, n_feats)``.

    Slots are numbered by their most frequent feature, features by rank in their slot.
    """
    top = materialize(top_features(dictionary, v), "top")
    rank = Window.partitionBy("slot").orderBy(F.desc("pv"), F.asc("sign"))
    ranked = top.withColumn("feat_idx", F.row_number().over(rank) - 1)
    leaders = ranked.where(F.col("feat_idx") == 0)  # one row per slot, at most V
    order = Window.orderBy(F.desc("pv"), F.asc("sign"))
    slot_idx = leaders.select("slot", (F.row_number().over(order) - 1).alias("slot_idx"))
    sizes = ranked.groupBy("slot").agg(F.count(F.lit(1)).cast("int").alias("n_feats"))
    slots = slot_idx.join(sizes, "slot")
    vocab = ranked.join(slot_idx, "slot").select(
        "sign", "slot", "pv", "slot_idx", "feat_idx"
    )
    return vocab, slots


def encode_slots(
    tokens: DataFrame,
    dictionary: DataFrame,
    vocab: DataFrame,
    slots: DataFrame,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(instance_id, label, slot_idx, feat_idx)`` per token.

    The slot comes from the training dictionary. Features unseen in training and slots
    outside the vocabulary drop out; other rare features share their slot's last index.
    The three tables meet per feature first, so tokens are joined once.
    """
    in_slots = lookup_join(dictionary.select("sign", "slot"), slots, "slot", "inner")
    codes = lookup_join(in_slots, vocab.select("sign", "feat_idx"), "sign").select(
        "sign", "slot_idx", F.coalesce("feat_idx", "n_feats").alias("feat_idx")
    )
    return lookup_join(
        tokens.select("instance_id", "label", "sign"), codes, "sign", "inner", hot=hot
    ).select("instance_id", "label", "slot_idx", "feat_idx")


def multi_hot(encoded: DataFrame) -> DataFrame:
    """Active indices per (instance, slot); at most the slot's vocabulary size plus one."""
    return encoded.groupBy("instance_id", "slot_idx").agg(
        F.array_sort(F.collect_set("feat_idx")).alias("active")
    )


def slot_offsets(slots: DataFrame) -> DataFrame:
    """Where each slot begins in one concatenated multi-hot row."""
    before = Window.orderBy("slot_idx").rowsBetween(Window.unboundedPreceding, -1)
    return slots.select(
        "slot_idx",
        "n_feats",
        F.coalesce(F.sum(F.col("n_feats") + 1).over(before), F.lit(0)).cast("int").alias("offset"),
    )


def index_rows(encoded: DataFrame, slots: DataFrame, instances: DataFrame) -> DataFrame:
    """``(instance_id, label, idx)``: one row per instance with its distinct positions.

    Positions are distinct and below V + number of slots, which bounds the array. It is
    empty for ``instances`` (instance_id, label) of which nothing was encoded.
    """
    flat = lookup_join(encoded, slot_offsets(slots), "slot_idx", "inner").withColumn(
        "at", F.col("offset") + F.col("feat_idx")
    )
    columns = ["instance_id", "label", "at"]
    everyone = instances.withColumn("at", F.lit(None).cast("int")).select(columns)
    return flat.select(columns).unionByName(everyone).groupBy("instance_id").agg(
        F.max("label").alias("label"), F.array_sort(F.collect_set("at")).alias("idx")
    )


def pool_embeddings(
    encoded: DataFrame,
    embedding: DataFrame,
    instances: DataFrame,
    n_slots: int,
    size: int,
    dedupe: bool = False,
) -> DataFrame:
    """``(instance_id, slot_idx, v)``: summed embedding rows; zeros for silent slots.

    ``embedding`` is ``(slot_idx, feat_idx, v)`` over the vocabulary. A repeated token
    adds its row again unless ``dedupe``. All of ``instances`` get all slots through rows
    of zeros that join the same sum.
    """
    cell = F.shiftleft(F.col("slot_idx").cast("bigint"), 32) + F.col("feat_idx")
    tokens = encoded.select("instance_id", "slot_idx", cell.alias("cell"))
    if dedupe:
        tokens = tokens.distinct()
    columns = [f"v{i}" for i in range(size)]
    table = embedding.select(
        cell.alias("cell"),
        *[factor(F.col("v"), i).cast("double").alias(c) for i, c in enumerate(columns)],
    )
    found = lookup_join(tokens, table, "cell", "inner").select("instance_id", "slot_idx", *columns)
    zeros = instances.select(
        "instance_id",
        F.explode(F.array(*[F.lit(i) for i in range(n_slots)]).cast("array<int>")).alias("slot_idx"),
        *[F.lit(0.0).alias(c) for c in columns],
    )
    summed = (
        found.unionByName(zeros)
        .groupBy("instance_id", "slot_idx")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )
    return summed.select("instance_id", "slot_idx", F.array(*columns).alias("v"))


def embedding_moments(pooled: DataFrame, size: int) -> DataFrame:
    """``(slot_idx, dim, mean, variance)`` of the pooled vectors, population variance."""
    stats = whole_vectors(pooled, "v", size).groupBy("slot_idx").agg(
        *[F.avg(factor(F.col("v"), i)).alias(f"m{i}") for i in range(size)],
        *[F.var_pop(factor(F.col("v"), i)).alias(f"s{i}") for i in range(size)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("dim"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("variance")
            )
            for i in range(size)
        ]
    )
    return stats.select("slot_idx", F.explode(rows).alias("d")).select("slot_idx", "d.*")


def update_moments(
    moving: DataFrame | None, batch: DataFrame, decay: float = MOVING_DECAY
) -> DataFrame:
    """Fold one batch's moments into the moving averages."""
    keys = ["slot_idx", "dim"]
    if moving is None:
        old_mean, old_variance = F.lit(START_MEAN), F.lit(START_VARIANCE)
        joined = batch
    else:
        old = moving.select(*keys, F.col("mean").alias("_m"), F.col("variance").alias("_s"))
        joined = batch.join(old, keys, "left")
        old_mean = F.coalesce("_m", F.lit(START_MEAN))
        old_variance = F.coalesce("_s", F.lit(START_VARIANCE))
    return joined.select(
        *keys,
        (old_mean * decay + F.col("mean") * (1 - decay)).alias("mean"),
        (old_variance * decay + F.col("variance") * (1 - decay)).alias("variance"),
    )
