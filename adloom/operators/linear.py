"""Linear scores, their gradients, and the frames that carry weights.

Tokens are ``(instance_id, label, sign, ...)``, one row per feature occurrence; a
weight frame is ``(sign, w)``, unique on ``sign``. An instance is never gathered: its
score is a sum that combines before the shuffle, and its residual goes back to its
tokens through a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.columns import LOSS_FLOOR, LR_BOUND, log_loss_term, sigmoid_clamped
from adloom.operators.lookup import HotKeys, lookup_join
from adloom.workspace import materialize


def attach_weights(
    tokens: DataFrame, weights: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Each token with its feature's weight, 0 if it has none."""
    nonzero = weights.where(F.col("w") != 0).select("sign", "w")
    joined = lookup_join(tokens, nonzero, "sign", "left", hot=hot)
    return joined.withColumn("w", F.coalesce("w", F.lit(0.0)))


def score_linear(
    tokens: DataFrame,
    weights: DataFrame,
    bound: float = LR_BOUND,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(instance_id, label, p)``; a repeated token adds its weight again."""
    return (
        attach_weights(tokens, weights, hot)
        .groupBy("instance_id")
        .agg(F.max("label").alias("label"), F.sum("w").alias("z"))
        .select("instance_id", "label", sigmoid_clamped(F.col("z"), bound).alias("p"))
    )


def token_gradient(
    tokens: DataFrame,
    preds: DataFrame,
    n_instances: int | None = None,
    hot: HotKeys | None = None,
    colocated: bool = False,
) -> DataFrame:
    """``(sign, g, touched)``: summed residuals and occurrences per feature.

    ``n_instances`` bounds the number of predictions; ``colocated`` tokens stay where they are.
    """
    residuals = preds.select("instance_id", (F.col("p") - F.col("label")).alias("r"))
    return (
        lookup_join(
            tokens.where(F.col("sign").isNotNull()).select("instance_id", "sign"),
            residuals,
            "instance_id",
            "inner",
            right_rows=n_instances,
            hot=hot,
            colocated=colocated,
        )
        .groupBy("sign")
        .agg(F.sum("r").alias("g"), F.count(F.lit(1)).alias("touched"))
    )


def residual_tokens(
    tokens: DataFrame, weights: DataFrame, once: bool = False, hot: HotKeys | None = None
) -> DataFrame:
    """``(instance_id, sign, r)``: each token with its instance's residual, without a join back.

    Meant for tokens that lie together by instance: the window then needs no shuffle. ``once``
    keeps one row per instance and sign; the score counts repeated tokens all the same.
    """
    whole = Window.partitionBy("instance_id")
    p = sigmoid_clamped(F.sum("w").over(whole), LR_BOUND)
    residual = (p - F.max("label").over(whole)).alias("r")
    scored = attach_weights(tokens, weights, hot).select("instance_id", "sign", residual)
    found = scored.where(F.col("sign").isNotNull())
    return found.groupBy("instance_id", "sign").agg(F.max("r").alias("r")) if once else found


def gradient_linear(
    tokens: DataFrame, weights: DataFrame, n_instances: int | None = None
) -> DataFrame:
    """``(sign, g)`` of the summed log loss; a repeated token counts again."""
    preds = materialize(score_linear(tokens, weights), "preds")
    return token_gradient(tokens, preds, n_instances).select("sign", "g")


def index_gradient(gradient: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(idx, g)`` for features in the dictionary ``(sign, idx)``."""
    return gradient.join(dictionary.select("sign", "idx"), "sign").select("idx", "g")


def merge_weights(weights: DataFrame, delta: DataFrame) -> DataFrame:
    """Add ``delta`` (sign, w) to the weights; signs new to either side start at 0."""
    return (
        weights.select("sign", "w")
        .unionByName(delta.select("sign", "w"))
        .groupBy("sign")
        .agg(F.sum("w").alias("w"))
    )


def sampled_count(tokens: DataFrame) -> DataFrame:
    """Number of instances behind the tokens; ids combine before the shuffle."""
    return tokens.select("instance_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def weight_norms(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.sum(F.col("w") * F.col("w")).alias("l2_sq"), F.sum(F.abs("w")).alias("l1")
    )


def objective(
    preds: DataFrame, weights: DataFrame, l1: float = 0.0, l2: float = 0.0, mean: bool = False
) -> DataFrame:
    """One row ``(objective)``: log loss + l2/2 * |w|^2 + l1 * |w|_1, over n if ``mean``.

    Both parts shrink to one row each before they meet.
    """
    loss = preds.agg(
        F.sum(log_loss_term(F.col("label"), F.col("p"), LOSS_FLOOR)).alias("part"),
        F.count(F.lit(1)).alias("n"),
    )
    penalty = weights.agg(
        F.sum(0.5 * l2 * F.col("w") * F.col("w") + l1 * F.abs("w")).alias("part"),
        F.lit(0).cast("bigint").alias("n"),
    )
    total = loss.unionByName(penalty).agg(
        F.coalesce(F.sum("part"), F.lit(0.0)).alias("total"), F.sum("n").alias("n")
    )
    value = F.try_divide("total", "n") if mean else F.col("total")
    return total.select(value.alias("objective"))


def loss_and_gradient(
    tokens: DataFrame,
    weights: DataFrame,
    dictionary: DataFrame,
    l1: float = 0.0,
    l2: float = 0.0,
    mean: bool = False,
    n_instances: int | None = None,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Objective (one row) and ``(sign, idx, g)`` for every dictionary feature.

    The gradient covers the smooth part: log loss and the l2 term. With ``mean`` both
    are divided by the number of instances.
    """
    preds = materialize(score_linear(tokens, weights, hot=hot), "preds")  # used twice
    n_instances = n_instances or preds.count()
    n = n_instances if mean else 1
    raw = token_gradient(tokens, preds, n_instances, hot).select("sign", "g")
    gradient = (
        dictionary.select("sign", "idx")
        .join(raw, "sign", "left")
        .join(weights.select("sign", "w"), "sign", "left")
        .select(
            "sign",
            "idx",
            (
                (F.coalesce("g", F.lit(0.0)) + l2 * F.coalesce("w", F.lit(0.0))) / n
            ).alias("g"),
        )
    )
    return objective(preds, weights, l1, l2, mean), gradient


def pseudo_gradient(gradient: DataFrame, weights: DataFrame, l1: float) -> DataFrame:
    """``(sign, pg)``: the steepest slope of loss + l1 * |w|_1; all 0 at its optimum."""
    g, w = F.col("g"), F.coalesce("w", F.lit(0.0))
    slope = (
        F.when(w > 0, g + l1)
        .when(w < 0, g - l1)
        .when(g < -l1, g + l1)
        .when(g > l1, g - l1)
        .otherwise(0.0)
    )
    return gradient.join(weights.select("sign", "w"), "sign", "left").select(
        "sign", slope.alias("pg")
    )
