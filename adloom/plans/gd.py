"""Logistic regression by sampled gradient descent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators.lookup import HotKeys
from adloom.operators.linear import residual_tokens, score_linear, token_gradient
from adloom.operators.metrics import evaluate
from adloom.plans.training import (
    Fit,
    OnIteration,
    history_frame,
    lay_out,
    stalled,
)
from adloom.workspace import materialize, release, scratch

# The replaced jobs' settings.
LEARNING_RATE = 0.5
THETA = 4.0
RATE = 0.01
MAX_ITER = 1000


def no_weights(tokens: DataFrame) -> DataFrame:
    """An empty weight frame whose sign has the tokens' type."""
    return tokens.select("sign", F.lit(0.0).alias("w")).where(F.lit(False))


def gd_step(
    tokens: DataFrame,
    weights: DataFrame,
    n_sampled: int,
    learning_rate: float = LEARNING_RATE,
    theta: float = THETA,
    mode: str = "aggregated",
    n_expected: float | None = None,
    compat: bool = False,
    hot: HotKeys | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Weights after one step over the sampled ``tokens``.

    ``aggregated`` sums residuals over every token, divides by the sampled count and
    decays each touched weight once. ``per_instance`` counts a feature once per
    instance, divides by the expected count ``n_expected`` and decays a weight once
    per instance that holds it. ``compat`` grows weights instead of decaying them, as
    the replaced jobs did. Over ``colocated`` tokens residuals are taken where the instance
    lies, and the one shuffle is the sum by sign.
    """
    decay = -theta if compat else theta
    once = mode == "per_instance"
    if colocated:
        residuals = residual_tokens(tokens, weights, once, hot)
        gradient = residuals.select("sign", F.col("r").alias("g"), F.lit(1).cast("bigint").alias("touched"))
    else:
        counted = tokens.select("instance_id", "sign").distinct() if once else tokens
        gradient = token_gradient(counted, score_linear(tokens, weights, hot=hot), n_sampled, hot)
    if once:
        n = float(n_expected if n_expected is not None else n_sampled)
        pull = decay / n * F.col("touched") * F.col("w")
    else:
        n = float(n_sampled)
        pull = F.when(F.col("touched") > 0, decay * F.col("w")).otherwise(0.0)
    # Old weights and gradient meet in one aggregation; either side may be missing.
    old = weights.select(
        "sign", "w", F.lit(0.0).alias("g"), F.lit(0).cast("bigint").alias("touched")
    )
    new = gradient.select("sign", F.lit(0.0).alias("w"), "g", "touched")
    both = (
        old.unionByName(new)
        .groupBy("sign")
        .agg(F.sum("w").alias("w"), F.sum("g").alias("g"), F.sum("touched").alias("touched"))
    )
    return both.select(
        "sign", (F.col("w") - learning_rate / n * (F.col("g") + pull)).alias("w")
    )


def train_lr_gd(
    train: DataFrame,
    evaluation: DataFrame,
    learning_rate: float = LEARNING_RATE,
    theta: float = THETA,
    rate: float = RATE,
    max_iter: int = MAX_ITER,
    mode: str = "aggregated",
    compat: bool = False,
    tol: float | None = None,
    resolution: int | None = None,
    on_iteration: OnIteration | None = None,
    draw: int | None = None,
    colocate: bool = False,
) -> Fit:
    """Iterate ``gd_step`` over rotating samples, evaluating after each step.

    With a seed ``draw`` every iteration draws a sample of its own; ``colocate`` buckets the
    training tokens by instance (see ``lay_out``). ``train`` and ``evaluation`` are token frames. Weights are written every iteration, and
    those before them deleted unless ``on_iteration(i, weights)`` has been given them.
    """
    spark = train.sparkSession
    layout, laid = lay_out(train, rate, draw, colocate), lay_out(evaluation)
    held_out = laid.all()
    expected = layout.all().n_instances * rate
    weights, written = no_weights(layout.tokens), False
    rows: list[tuple] = []
    for i in range(max_iter):
        part = layout.sample(i)
        if part.n_instances:
            with scratch(spark):
                stepped = gd_step(
                    part.tokens,
                    weights,
                    part.n_instances,
                    learning_rate,
                    theta,
                    mode,
                    expected,
                    compat,
                    part.hot,
                    part.colocated,
                )
                stepped = materialize(stepped, f"weights-{i}", lasting=True)
            if written and not on_iteration:
                release(weights)
            weights, written = stepped, True
        with scratch(spark):
            preds = score_linear(held_out.tokens, weights, hot=held_out.hot)
            result = evaluate(preds, resolution).first()
        rows.append((i, part.n_instances, result["auc"], result["mae"], result["loss"]))
        if on_iteration:
            on_iteration(i, weights)
        if stalled([r[4] for r in rows], tol):
            break
    if written:  # unwritten weights read the laid-out tokens
        layout.release()
    laid.release()
    return Fit(weights, history_frame(spark, rows))
