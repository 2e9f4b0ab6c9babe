"""Factorization machine training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators.factor import fm_gradient, fm_step_search, score_fm
from adloom.operators.metrics import evaluate
from adloom.plans.training import Fit, OnIteration, history_frame, lay_out, stalled
from adloom.schema import SIGN_TEXT, STEP_TRACE
from adloom.workspace import materialize, release, scratch

# The replaced job's settings.
LEARNING_RATE = 1.0
THETA = 4.0
FACTORS = 8
RATE = 0.1
MAX_ITER = 1000
MIN_FREQ = 10000
INIT_SCALE = 0.001

_PRIME = 1000003
_STRIDE = 7919
_STEPS = 1 << 52


def init_model(
    features: DataFrame, k: int = FACTORS, scale: float = INIT_SCALE, seed: int | None = None,
    arithmetic: bool = False,
) -> DataFrame:
    """Zero weights and factors in [0, scale) for every sign of ``features``.

    Factors come from a hash of sign and component; with ``seed`` they are random.
    ``arithmetic`` takes multiples of the sign modulo a prime, which other engines can
    repeat; signs that differ by that prime then start equal. ``k=0`` gives empty factors,
    which makes the model a plain logistic regression.
    """
    def start(i: int):
        if seed is not None:
            # rand() adds the partition number to its seed: keep the components far apart
            return F.rand(seed + (i << 32)) * scale
        if not arithmetic:
            mixed = F.xxhash64(F.col("sign").cast(SIGN_TEXT), F.lit(i))  # one type, one hash
            return F.pmod(mixed, F.lit(_STEPS)) / F.lit(float(_STEPS)) * scale
        mixed = F.pmod(F.col("sign"), F.lit(_PRIME)).cast("bigint") * F.lit((i + 1) * _STRIDE)
        return F.pmod(mixed, F.lit(_PRIME)) / F.lit(float(_PRIME)) * scale

    factors = F.array(*[start(i) for i in range(k)]).cast("array<double>")
    return features.select("sign", F.lit(0.0).alias("w"), factors.alias("v"))


def train_fm(
    train: DataFrame,
    evaluation: DataFrame,
    features: DataFrame,
    k: int = FACTORS,
    learning_rate: float = LEARNING_RATE,
    theta: float = THETA,
    rate: float = RATE,
    max_iter: int = MAX_ITER,
    init_scale: float = INIT_SCALE,
    seed: int | None = None,
    compat: bool = False,
    tol: float | None = None,
    resolution: int | None = None,
    on_iteration: OnIteration | None = None,
    arithmetic: bool = False,
    draw: int | None = None,
) -> Fit:
    """Sampled gradient, step search over the whole train set, evaluation; repeated.

    ``features`` holds the signs of the vocabulary; ``arithmetic`` is that of ``init_model``;
    a seed ``draw`` draws every iteration's sample anew instead of rotating.
    Each model is written, and the one before it deleted unless ``on_iteration`` has been given it.
    """
    spark = train.sparkSession
    layout, laid = lay_out(train, rate, draw), lay_out(evaluation)
    whole, held_out = layout.all(), laid.all()
    model = materialize(init_model(features, k, init_scale, seed, arithmetic), "fm-start", lasting=True)
    rows: list[tuple] = []
    steps: list[tuple] = []
    for i in range(max_iter):
        part = layout.sample(i)
        if part.n_instances:
            with scratch(spark):
                gradient = fm_gradient(part.tokens, model, k, part.n_instances, part.hot)
                stepped, _, trace = fm_step_search(
                    whole.tokens,
                    model,
                    gradient,
                    k,
                    part.n_instances,
                    learning_rate,
                    theta,
                    compat,
                    whole.hot,
                )
                stepped = materialize(stepped, f"fm-{i}", lasting=True)
            if not on_iteration:
                release(model)
            model = stepped
            steps += [(i, m, loss) for m, loss in trace]
        with scratch(spark):
            preds = score_fm(held_out.tokens, model, k, held_out.hot)
            result = evaluate(preds, resolution).first()
        rows.append((i, part.n_instances, result["auc"], result["mae"], result["loss"]))
        if on_iteration:
            on_iteration(i, model)
        if stalled([r[4] for r in rows], tol):
            break
    layout.release()
    laid.release()
    return Fit(model, history_frame(spark, rows), spark.createDataFrame(steps, STEP_TRACE))
