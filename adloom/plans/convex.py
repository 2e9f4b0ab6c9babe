"""Logistic regression to convergence, with an l2 term or an elastic net.

The fitted objective is the sum of log losses + l2/2 * |w|^2 + l1 * |w|_1, without an
intercept. There are two solvers with the same result. ``tables`` keeps all vectors as
tables (see ``vector_free``) and shows its weights after each step. ``driver`` hands the
job to the L-BFGS and OWL-QN of pyspark.ml, which hold one number per feature on the
driver; it has fewer jobs per step and is taken where the features have been counted and
are few. Both count a label above 1 as one click.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators.linear import score_linear
from adloom.operators.metrics import evaluate
from adloom.operators.tokens import explode_tokens
from adloom.plans.packed import packed_part
from adloom.plans.training import Fit, OnIteration, Part, history_frame
from adloom.plans.vector_free import EARLY, EARLY_STEPS, Stage, elastic_path, minimise, start, training_part
from adloom.workspace import materialize, release

# The replaced jobs' decay and stopping tolerances.
THETA = 4.0
TOL_L2 = 1e-5
TOL_ELASTIC = 1e-4
# Fixed value: the replaced OWL-QN's length of history.
PATH_HISTORY = 10


#: Most features, counted, whose names and weights may go to the driver.
DRIVER_FEATURES = 1 << 18


@dataclass
class ConvexFit(Fit):
    objective: list[float] | None = None  # mean objective after each solver iteration
    stages: list[Stage] | None = None  # of the l1 path, from the tables solver


def _vectorizer(signs: list[str]) -> CountVectorizerModel:
    model = CountVectorizerModel.from_vocabulary(signs, inputCol="names", outputCol="features")
    return model.setBinary(False)  # a repeated token counts again


def _driver_fit(rows: DataFrame, features: DataFrame, n: int, l1: float, l2: float, max_iter: int, tol: float):
    """Weights and mean objectives of ``rows`` (label, names), ``n`` of them.

    At most ``DRIVER_FEATURES`` features are collected; the caller has counted them.
    """
    sign_type = features.schema["sign"].dataType
    signs = [r["name"] for r in features.select("sign").distinct().orderBy("sign").select(F.col("sign").cast("string").alias("name")).collect()]
    vectors = _vectorizer(signs).transform(rows)
    total = l1 + l2
    solver = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        family="binomial",
        fitIntercept=False,
        standardization=False,
        regParam=total / n,
        elasticNetParam=l1 / total if total else 0.0,
        maxIter=max_iter,
        tol=tol,
    )
    fitted = solver.fit(vectors.select("label", "features"))
    table = pd.DataFrame({"name": signs, "w": fitted.coefficients.toArray()})
    weights = (
        rows.sparkSession.createDataFrame(table, "name string, w double")
        .select(F.col("name").cast(sign_type).alias("sign"), "w")
        .where(F.col("w") != 0)
    )
    return weights, list(fitted.summary.objectiveHistory)


def _instance_names(instances: DataFrame) -> DataFrame:
    names = F.transform("feats", lambda f: f["sign"].cast("string"))
    binary = F.when(F.col("label") > 0, 1).otherwise(0).alias("label")  # counts above one are clicks too
    return instances.select(binary, names.alias("names"))


def _token_names(tokens: DataFrame) -> DataFrame:
    """One row per instance, as wide as the instance's own tokens."""
    names = F.collect_list(F.col("sign").cast("string")).alias("names")
    return tokens.groupBy("instance_id").agg(F.max("label").alias("label"), names).select("label", "names")


def _few(features: DataFrame) -> bool:
    return features.select("sign").distinct().limit(DRIVER_FEATURES + 1).count() <= DRIVER_FEATURES


def _fit(
    train: DataFrame,
    evaluation: DataFrame,
    features: DataFrame,
    l1: float,
    l2: float,
    max_iter: int,
    tol: float,
    resolution: int | None,
    solver: str | None,
    on_iteration: OnIteration | None,
) -> ConvexFit:
    spark, n = train.sparkSession, train.count()
    held_out = explode_tokens(evaluation, keep_empty=True)

    def measured(iteration: int, weights: DataFrame) -> tuple:
        result = evaluate(score_linear(held_out, weights), resolution).first()
        return iteration, n, result["auc"], result["mae"], result["loss"]

    if solver is None:
        solver = "driver" if not on_iteration and _few(features) else "path" if l1 else "tables"
    if solver == "driver":
        if on_iteration:
            raise ValueError("the driver's solver shows no weights between its steps; take solver='tables'")
        weights, objective = _driver_fit(_instance_names(train), features, n, l1, l2, max_iter, tol)
        return ConvexFit(weights, history_frame(spark, [measured(len(objective) - 1, weights)]), objective=objective)

    tokens = explode_tokens(train)
    part = packed_part(tokens, features) or training_part(tokens, features)
    history: list[tuple] = []
    objective: list[float] = []
    # Instances without any known feature have score 0 whatever the weights.
    rest = (n - part.n_instances) * math.log(2)

    def by_tables(own: Part, first: DataFrame, goal: float, last: bool = True) -> DataFrame:
        def visit(i: int, weights: DataFrame) -> None:
            history.append(measured(len(history), weights))
            on_iteration(len(history) - 1, weights)

        steps, bound = (max_iter, tol) if last else (min(max_iter, EARLY_STEPS), max(tol, EARLY))
        # Over packed tokens the path's fits end as those of the driver's solver do.
        options = {"history": PATH_HISTORY, "gain": bound} if own.packed and solver == "path" else {}
        found = minimise(own, first, goal, l2, steps, bound, visit=visit if on_iteration else None, **options)
        objective.extend((f + rest) / max(n, 1) for f in found.objective)
        weights = materialize(found.weights, "weights")
        if found.state is not first:
            release(found.state)
        return weights

    def by_survivors(own: Part, surviving: DataFrame, goal: float, last: bool) -> DataFrame:
        if own.packed or on_iteration or not _few(surviving):
            return by_tables(own, surviving, goal, last)
        rows = materialize(_token_names(own.tokens), "rows")
        size = rows.count()
        if not size:  # nothing survives, or nothing has a token
            return surviving.select("sign", "w").where("false")
        weights, seen = _driver_fit(rows, surviving, size, goal, l2, max_iter, tol if last else max(tol, EARLY))
        objective.extend((f * size + (n - size) * math.log(2)) / n for f in seen)
        release(rows)
        return weights

    stages = None
    if solver == "path":
        weights, stages = elastic_path(part, features, l1, l2, by_survivors, tol)
    elif solver == "tables":
        first = start(part, features, l2)
        weights = by_tables(part, first, l1)
        release(first)
    else:
        raise ValueError(f"solver is tables, path or driver, not {solver}")
    if not history:
        history.append(measured(max(len(objective) - 1, 0), weights))
    part.release()
    return ConvexFit(weights, history_frame(spark, history), objective=objective, stages=stages)


def train_lr_l2(
    train: DataFrame,
    evaluation: DataFrame,
    features: DataFrame,
    theta: float = THETA,
    max_iter: int = 200,
    tol: float = TOL_L2,
    resolution: int | None = None,
    solver: str | None = None,
    on_iteration: OnIteration | None = None,
) -> ConvexFit:
    """``train`` and ``evaluation`` are instance frames; ``features`` holds the signs.

    A label above 1, as ``label_mode="raw"`` gives, counts as one click in the fit. With
    ``on_iteration(i, weights)`` each step is evaluated and gives a row of history.
    ``solver`` is ``tables``, ``driver``, or left to the number of features. ``tol`` bounds
    the gradient against the weights' norm (tables) or the gain of a step (driver).
    """
    return _fit(train, evaluation, features, 0.0, theta, max_iter, tol, resolution, solver, on_iteration)


def train_lr_elastic(
    train: DataFrame,
    evaluation: DataFrame,
    features: DataFrame,
    l1: float = 0.0,
    l2: float = THETA,
    max_iter: int = 200,
    tol: float = TOL_ELASTIC,
    resolution: int | None = None,
    solver: str | None = None,
    on_iteration: OnIteration | None = None,
) -> ConvexFit:
    """As ``train_lr_l2`` with an l1 term; weights that end at 0 are left out.

    ``solver`` may also be ``path``, which lowers the l1 term in stages and fits what
    survives a screening; it is taken where the features are too many for the driver.
    """
    return _fit(train, evaluation, features, l1, l2, max_iter, tol, resolution, solver, on_iteration)
