"""AUC, mean absolute error and log loss over distributed predictions.

A prediction frame has ``label`` and ``p``. Equal scores share their mean rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.columns import LOSS_FLOOR, log_loss_term
from adloom.operators.ranking import range_ordered, running_before

_GRID = 1000


def log_loss(preds: DataFrame, floor: float = LOSS_FLOOR) -> DataFrame:
    """Sum, not mean, of the negative log likelihood."""
    return preds.agg(F.sum(log_loss_term(F.col("label"), F.col("p"), floor)).alias("loss"))


def mae(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg(F.abs(F.col("label") - F.col("p"))).alias("mae"))


def _by_score(preds: DataFrame, resolution: int | None) -> DataFrame:
    """One row per distinct score; a heavily tied score collapses before the shuffle."""
    score = F.col("p") + F.lit(0.0)  # -0.0 and 0.0 are one score
    if resolution is not None:
        score = F.round(score, resolution) + F.lit(0.0)
    return preds.groupBy(score.alias("score")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col("label") - F.col("p"))).alias("abs_error"),
        F.sum(log_loss_term(F.col("label"), F.col("p"))).alias("loss"),
    )


def _in_parts(scores: DataFrame, resolution: int | None) -> DataFrame:
    """Give every score row a part number that ascends with the score.

    Rounded probabilities have few distinct values, so a fixed grid is even enough;
    exact scores, and scores that are no probabilities, are range-partitioned because click-through rates cluster.
    """
    if resolution is not None and resolution <= 6:
        ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
        if ends["low"] is None or 0 <= ends["low"] and ends["high"] <= 1:
            return scores.withColumn("part", F.floor(F.col("score") * _GRID).cast("int"))
    return range_ordered(scores, "score", "scores").drop("row")


def _area(rank_sum: Column, pos: Column, neg: Column) -> Column:
    return F.when((pos > 0) & (neg > 0), rank_sum / (pos.cast("double") * neg.cast("double")))


def evaluate(preds: DataFrame, resolution: int | None = None) -> DataFrame:
    """One row ``(auc, mae, loss, n, n_pos, n_neg)``; AUC is NULL without both classes.

    ``resolution`` rounds the score to that many digits before ranking, as written
    prediction files do; loss and MAE always use the full score.
    """
    parts = _in_parts(_by_score(preds, resolution), resolution)
    within = Window.partitionBy("part").orderBy("score")
    below = F.sum("neg").over(within) - F.col("neg")
    won = F.col("pos") * (below + 0.5 * F.col("neg"))
    # At most 1001 rows, or one per shuffle partition, are left after this step.
    per_part = (
        parts.withColumn("won", won)
        .groupBy("part")
        .agg(*[F.sum(c).alias(c) for c in ("won", "abs_error", "loss", "n", "pos", "neg")])
    )
    sums = running_before(per_part, "part", "neg").agg(
        F.sum(F.col("won") + F.col("pos") * F.col("neg_before")).alias("won"),
        F.sum("abs_error").alias("abs_error"),
        F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
    )
    return sums.select(
        _area(F.col("won"), F.col("n_pos"), F.col("n_neg")).alias("auc"),
        F.try_divide("abs_error", "n").alias("mae"),
        "loss",
        "n",
        "n_pos",
        "n_neg",
    )


def auc(preds: DataFrame, resolution: int | None = None) -> DataFrame:
    return evaluate(preds, resolution).select("auc", "n_pos", "n_neg")
