"""Factorization machine: scores, gradients and the step-size search.

A model frame is ``(sign, w, v)`` with ``v`` an array of K factors or empty. The sum
over pairs inside an instance is never spelled out: it follows from per-instance sums
of the factors and of their squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.columns import FM_BOUND, factor, log_loss_term, sigmoid_clamped
from adloom.operators.lookup import HotKeys, lookup_join
from adloom.workspace import materialize, release

MAX_MULTIPLIER = 99  # fixed value: the search tries multipliers 1 to 99
_FIRST_CHUNK = 8


def whole_vectors(df: DataFrame, v: str, k: int) -> DataFrame:
    """``df``, failing on a vector that is neither empty nor of length k."""
    wrong = F.raise_error(F.format_string(f"a vector of {k} components has %d", F.size(v)))
    checked = F.when(F.coalesce(F.size(v), F.lit(0)).isin(-1, 0, k), F.col(v)).otherwise(wrong.cast(df.schema[v].dataType))
    return df.withColumn(v, checked)


def sum_vectors(df: DataFrame, key: str, v: str, k: int) -> DataFrame:
    """Element-wise sum of K-vectors per key; empty vectors add nothing.

    The result is empty where every vector of the key is. Any other length is an error.
    """
    sums = whole_vectors(df, v, k).groupBy(key).agg(
        F.max(F.size(v)).alias("_n"), *[F.sum(factor(F.col(v), i)).alias(f"_{i}") for i in range(k)]
    )
    filled = F.array(*[F.col(f"_{i}") for i in range(k)])
    empty = F.array().cast("array<double>")
    return sums.select(key, F.when(F.col("_n") > 0, filled).otherwise(empty).alias(v))


def _total(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def usable_factors(model: DataFrame, k: int) -> DataFrame:
    """Factors whose length is not K take no part in the pair term."""
    return model.select(
        "sign",
        "w",
        *[
            F.when(F.size("v") == k, factor(F.col("v"), i)).otherwise(0.0).alias(f"v{i}")
            for i in range(k)
        ],
    )


def _fm_sums(
    tokens: DataFrame, model: DataFrame, k: int, hot: HotKeys | None = None
) -> DataFrame:
    """Per instance: label, margin ``z`` and the factor sums ``s0..``."""
    table = usable_factors(model, k).withColumn(
        "q", _total([F.col(f"v{i}") * F.col(f"v{i}") for i in range(k)])
    )
    joined = lookup_join(tokens.select("instance_id", "label", "sign"), table, "sign", hot=hot)
    zero = F.lit(0.0)
    sums = joined.groupBy("instance_id").agg(
        F.max("label").alias("label"),
        F.sum(F.coalesce("w", zero)).alias("linear"),
        F.sum(F.coalesce("q", zero)).alias("q"),
        *[F.sum(F.coalesce(f"v{i}", zero)).alias(f"s{i}") for i in range(k)],
    )
    squares = _total([F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)])
    return sums.withColumn("z", F.col("linear") + 0.5 * (squares - F.col("q")))


def score_fm(
    tokens: DataFrame, model: DataFrame, k: int, hot: HotKeys | None = None
) -> DataFrame:
    """``(instance_id, label, p)``."""
    return _fm_sums(tokens, model, k, hot).select(
        "instance_id", "label", sigmoid_clamped(F.col("z"), FM_BOUND).alias("p")
    )


def fm_gradient(
    tokens: DataFrame,
    model: DataFrame,
    k: int,
    n_instances: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(sign, g, gv)`` for features of the model that occur in the tokens.

    A factor's gradient sums residual * (factor sum of the instance - own factor) over
    occurrences. The own factor is the same in every occurrence, so tokens only carry
    the residual and residual * sum, and the model joins once per feature at the end.
    """
    sums = _fm_sums(tokens, model, k, hot)
    r = sigmoid_clamped(F.col("z"), FM_BOUND) - F.col("label")
    residuals = sums.select(
        "instance_id", r.alias("r"), *[(r * F.col(f"s{i}")).alias(f"rs{i}") for i in range(k)]
    )
    summed = (
        lookup_join(
            tokens.select("instance_id", "sign"),
            residuals,
            "instance_id",
            "inner",
            right_rows=n_instances,
            hot=hot,
        )
        .groupBy("sign")
        .agg(F.sum("r").alias("g"), *[F.sum(f"rs{i}").alias(f"rs{i}") for i in range(k)])
    )
    own = F.array(
        *[F.col(f"rs{i}") - factor(F.col("v"), i) * F.col("g") for i in range(k)]
    ).cast("array<double>")
    return summed.join(model.select("sign", "v"), "sign").select(
        "sign",
        "g",
        F.when(F.size("v") == k, own).otherwise(F.array().cast("array<double>")).alias("gv"),
    )


def step_direction(
    model: DataFrame, gradient: DataFrame, rate: float, theta: float, compat: bool = False
) -> DataFrame:
    """``(sign, w, v, dw, dv)``: the model and what one unit of step subtracts from it.

    ``rate`` is the learning rate over the number of sampled instances. The decay term
    shrinks the weights; ``compat`` flips its sign and drops features the sample did
    not touch, as the replaced jobs did.
    """
    decay = -theta if compat else theta
    step = F.transform(
        F.arrays_zip(F.col("gv"), F.col("v")),
        lambda x: rate * (x["gv"] + decay * x["v"]),
    )
    moved = gradient.join(model, "sign", "inner" if compat else "right")
    touched = F.col("g").isNotNull()
    still = F.transform("v", lambda x: F.lit(0.0))
    return moved.select(
        "sign",
        "w",
        "v",
        F.when(touched, rate * (F.col("g") + decay * F.col("w"))).otherwise(0.0).alias("dw"),
        F.when(touched, F.when(F.size("gv") > 0, step).otherwise(still))
        .otherwise(still)
        .alias("dv"),
    )


def take_step(direction: DataFrame, multiplier: float) -> DataFrame:
    """The model ``(sign, w, v)`` after ``multiplier`` units of the step."""
    m = F.lit(float(multiplier))
    return direction.select(
        "sign",
        (F.col("w") - m * F.col("dw")).alias("w"),
        F.transform(
            F.arrays_zip(F.col("v"), F.col("dv")), lambda x: x["v"] - m * x["dv"]
        ).alias("v"),
    )


def margin_curve(
    tokens: DataFrame, direction: DataFrame, k: int, hot: HotKeys | None = None
) -> DataFrame:
    """``(instance_id, label, a, b, c)``: the margin is a + b*m + c*m^2 at multiplier m.

    Weights move linearly with m, so one pass answers every multiplier.
    """
    def at(v: str, i: int) -> Column:
        return F.when(F.size("v") == k, factor(F.col(v), i)).otherwise(0.0)

    pairs = range(k)
    table = direction.select(
        "sign",
        "w",
        "dw",
        *[at("v", i).alias(f"v{i}") for i in pairs],
        *[at("dv", i).alias(f"d{i}") for i in pairs],
    )
    table = table.select(
        "*",
        _total([F.col(f"v{i}") * F.col(f"v{i}") for i in pairs]).alias("vv"),
        _total([F.col(f"v{i}") * F.col(f"d{i}") for i in pairs]).alias("vd"),
        _total([F.col(f"d{i}") * F.col(f"d{i}") for i in pairs]).alias("dd"),
    )
    joined = lookup_join(tokens.select("instance_id", "label", "sign"), table, "sign", hot=hot)
    sums = joined.groupBy("instance_id").agg(
        F.max("label").alias("label"),
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in table.columns if c != "sign"],
    )

    def cross(x: str, y: str) -> Column:
        return _total([F.col(f"{x}{i}") * F.col(f"{y}{i}") for i in pairs])

    return sums.select(
        "instance_id",
        "label",
        (F.col("w") + 0.5 * (cross("v", "v") - F.col("vv"))).alias("a"),
        (-F.col("dw") - (cross("v", "d") - F.col("vd"))).alias("b"),
        (0.5 * (cross("d", "d") - F.col("dd"))).alias("c"),
    )


def step_losses(curve: DataFrame, first: int, last: int) -> DataFrame:
    """``(multiplier, train_loss)`` for multipliers first..last in one job."""
    tried = range(first, last + 1)

    def loss(m: int) -> Column:
        z = F.col("a") + m * F.col("b") + m * m * F.col("c")
        return F.sum(log_loss_term(F.col("label"), sigmoid_clamped(z, FM_BOUND)))

    sums = curve.agg(*[loss(m).alias(f"m{m}") for m in tried])
    rows = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"m{m}").alias("train_loss")) for m in tried])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def search_step(
    tokens: DataFrame, direction: DataFrame, k: int, hot: HotKeys | None = None
) -> tuple[int, list[tuple[int, float]]]:
    """The multiplier before the first one that does not lower the train loss.

    Returns it with the trace of ``(multiplier, train_loss)`` up to that first failure.
    Multipliers are tried in growing chunks; only one number per multiplier is fetched.
    """
    curve = materialize(margin_curve(tokens, direction, k, hot).drop("instance_id"), "curve")
    try:
        return _search(curve)
    finally:
        release(curve)  # a row per instance; nothing reads it again


def _search(curve: DataFrame) -> tuple[int, list[tuple[int, float]]]:
    trace: list[tuple[int, float]] = []
    first, size = 1, _FIRST_CHUNK
    while first <= MAX_MULTIPLIER:
        last = min(first + size - 1, MAX_MULTIPLIER)
        for m, loss in sorted(tuple(r) for r in step_losses(curve, first, last).collect()):
            if trace and loss >= trace[-1][1]:
                return m - 1, trace + [(m, loss)]
            trace.append((m, loss))
        first, size = last + 1, size * 2
    return MAX_MULTIPLIER, trace


def fm_step_search(
    tokens: DataFrame,
    model: DataFrame,
    gradient: DataFrame,
    k: int,
    n_sampled: int,
    learning_rate: float = 1.0,
    theta: float = 4.0,
    compat: bool = False,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, int, list[tuple[int, float]]]:
    """The stepped model, the accepted multiplier and the search trace."""
    direction = materialize(
        step_direction(model, gradient, learning_rate / n_sampled, theta, compat), "direction"
    )
    multiplier, trace = search_step(tokens, direction, k, hot)
    return take_step(direction, multiplier), multiplier, trace
