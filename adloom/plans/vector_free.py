"""Convex fits whose vectors stay tables: L-BFGS, and its orthant-wise form for an l1 term.

One table per iteration holds, for each feature, its weight ``w``, the gradient ``g`` of the
smooth part (log loss and l2 term), a scale ``h`` (about the inverse of its curvature), and
the last steps ``s`` and changes of gradient ``y``. In scaled variables the search direction
is a combination of these columns whose coefficients follow from their inner products alone,
so an iteration brings (2m+1)^2 numbers at most and a few sums to the driver, however many
features there are. Scores of the weights and of the direction come
out of one pass over the tokens; as scores are linear in the step, one more aggregate gives
the objective at all trial steps at once. With an l1 term a trial step is cut off where a
weight would change its sign, so a few trial weights are scored side by side instead.

Where a vector may be broadcast, ``packed`` holds the tokens, and the columns are arrays: one pass
then gives the objective and the gradient at a full step, which is nearly always taken. The limit
of a broadcast bounds what the driver holds; beyond it, all vectors are tables as said above.

``elastic_path`` lowers the l1 term to its goal in stages. The strong rule drops the
features that will most likely stay at 0, and a stage's fit reads the tokens of the
surviving ones only. After the last stage the pseudo-gradient of all dropped features is
checked: those that would move come back, and the stage is fitted again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.linear import pseudo_gradient, token_gradient
from adloom.operators.lookup import lookup_join
from adloom.plans.training import Part, lay_out
from adloom.workspace import materialize, release

# Fixed value: the replaced jobs' length of history.
HISTORY = 5
#: Trial steps, each half of the one before, and how many are tried at once.
TRIALS, GROUP = 20, 4
SUFFICIENT = 1e-4
#: Share of the objective below which a difference is rounding.
ROUNDING = 1e-11
#: Steps whose mean gain is compared.
GAINS = 5
#: The l1 terms of two stages differ by this factor at most (the strong rule drops nothing
#: at 0.5); stages before the last end at this tolerance, or after so many steps.
RATIO, EARLY, EARLY_STEPS = 0.55, 1e-2, 20

Visit = Callable[[int, DataFrame], None]
Solve = Callable[[Part, DataFrame, float, bool], DataFrame]


@dataclass
class Solution:
    """The table of the last iteration, and the objective (a sum) before and after each."""

    state: DataFrame
    objective: list[float] = field(default_factory=list)
    norm: float = 0.0  # of the pseudo-gradient

    @property
    def weights(self) -> DataFrame:
        return self.state.where(F.col("w") != 0).select("sign", "w")


def softplus_loss(label: Column, z: Column) -> Column:
    """Log loss at margin ``z``, without overflow at either end."""
    return F.greatest(z, F.lit(0.0)) - label * z + F.log1p(F.exp(-F.abs(z)))


def _slope(l1: float) -> Column:
    """The pseudo-gradient in a table with ``w`` and ``g``."""
    if not l1:
        return F.col("g")
    w, g = F.col("w"), F.col("g")
    return (
        F.when(w > 0, g + l1).when(w < 0, g - l1).when(g < -l1, g + l1).when(g > l1, g - l1).otherwise(F.lit(0.0))
    )


def coefficients(gram: np.ndarray) -> np.ndarray:
    """The direction -H * pg over the basis (s of each step, y of each step, pg).

    ``gram`` holds the inner products of the basis. Oldest steps come first.
    """
    m = (len(gram) - 1) // 2
    by = np.zeros(2 * m + 1)
    by[-1] = -1.0
    along = np.zeros(m)
    for i in reversed(range(m)):
        along[i] = by @ gram[:, i] / gram[i, m + i]
        by[m + i] -= along[i]
    if m:
        by *= gram[m - 1, 2 * m - 1] / gram[2 * m - 1, 2 * m - 1]
    for i in range(m):
        by[i] += along[i] - by @ gram[:, m + i] / gram[i, m + i]
    return by


def _combination(names: list[Column], by: np.ndarray) -> Column:
    total = F.lit(0.0)
    for name, factor in zip(names, by):
        total = total + name * F.lit(float(factor))
    return total


class _Iteration:
    """What one iteration needs of the state: columns, inner products and the direction."""

    def __init__(self, state: DataFrame, l1: float, before: _Iteration | None = None):
        self.state, self.l1 = state, l1
        kept = [c[1:] for c in state.columns if c.startswith("s") and c[1:].isdigit()]
        self.kept = sorted(kept, key=int, reverse=True)  # 0 is the newest
        slope, root = _slope(l1), F.sqrt("h")
        basis = [*[F.col(f"s{i}") / root for i in self.kept], *[F.col(f"y{i}") * root for i in self.kept], slope * root]
        size = len(basis)
        names = [*[("s", int(i)) for i in self.kept], *[("y", int(i)) for i in self.kept], ("g", 0)]
        # Products of what was there before are known: they only moved on by one place.
        self.products, pairs = {}, []
        for i in range(size):
            for j in range(i, size):
                (a, m), (b, n) = names[i], names[j]
                known = before.products.get(((a, m - 1), (b, n - 1))) if before and "g" not in (a, b) else None
                if known is None:
                    pairs.append(F.sum(basis[i] * basis[j]).alias(f"p{i}_{j}"))
                else:
                    self.products[names[i], names[j]] = known
        w = F.col("w")
        norms = [F.sum(w * w).alias("ww"), F.sum(F.abs(w)).alias("w1"), F.sum(slope * slope).alias("gg")]
        row = state.agg(*pairs, *norms).first()
        gram = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                key = names[i], names[j]
                if key not in self.products:
                    self.products[key] = row[f"p{i}_{j}"] or 0.0
                gram[i, j] = gram[j, i] = self.products[key]
        self.norm = float(np.sqrt(row["gg"] or 0.0))
        self.ww, self.w1 = row["ww"] or 0.0, row["w1"] or 0.0
        # Steps without curvature say nothing.
        m = len(self.kept)
        good = [i for i in range(m) if gram[i, m + i] > 1e-14 * gram[m + i, m + i]]
        at = [*good, *[m + i for i in good], 2 * m]
        by = coefficients(gram[np.ix_(at, at)])
        d = root * _combination([basis[i] for i in at], by)
        # An orthant-wise step never goes up the slope.
        self.direction = F.when(d * slope < 0, d).otherwise(F.lit(0.0)) if l1 else d
        self.slope = slope

    def step(self, alpha: float) -> Column:
        """Weights after a step, which stay in their orthant under an l1 term."""
        moved = F.col("w") + F.lit(float(alpha)) * self.direction
        if not self.l1:
            return moved
        side = F.when(F.col("w") != 0, F.signum("w")).otherwise(-F.signum(self.slope))
        return F.when(F.signum(moved) == side, moved).otherwise(F.lit(0.0))


def _margins(part: Part, table: DataFrame, names: list[str], n_features: int) -> DataFrame:
    """``(instance_id, label, *names)``: the sums of the named columns over each instance's tokens."""
    tokens = part.tokens.select("instance_id", "label", "sign")
    joined = lookup_join(tokens, table.select("sign", *names), "sign", "left", right_rows=n_features, hot=part.hot)
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in names]
    return materialize(joined.groupBy("instance_id").agg(F.max("label").alias("label"), *sums), "margins")


def _objective(loss: float, square: float, absolute: float, l1: float, l2: float) -> float:
    return loss + 0.5 * l2 * square + l1 * absolute


def _search(it: _Iteration, part: Part, l1: float, l2: float, now: float | None, n_features: int):
    """The accepted step: its weights, the margins' table, their column, and the objective.

    None if no trial step lowers the objective.
    """
    label = F.col("label")
    groups = [[0.5**i for i in range(begin, begin + GROUP)] for begin in range(0, TRIALS, GROUP)]
    if not l1:
        table = it.state.select("sign", F.col("w").alias("z"), it.direction.alias("zd"))
        margins = _margins(part, table, ["z", "zd"], n_features)
        w, d = F.col("w"), it.direction
        row = it.state.agg(F.sum(w * d).alias("wd"), F.sum(d * d).alias("dd"), F.sum(it.slope * d).alias("gd")).first()
        for alphas in groups:
            at = [0.0, *alphas]
            losses = [F.sum(softplus_loss(label, F.col("z") + a * F.col("zd"))).alias(f"f{i}") for i, a in enumerate(at)]
            found = margins.agg(*losses).first()
            value = [
                _objective(found[f"f{i}"] or 0.0, it.ww + 2 * a * row["wd"] + a * a * row["dd"], 0.0, l1, l2)
                for i, a in enumerate(at)
            ]
            for i, a in enumerate(alphas, start=1):
                if value[i] <= value[0] + SUFFICIENT * a * row["gd"] + ROUNDING * abs(value[0]):
                    return a, margins, F.col("z") + a * F.col("zd"), value[0], value[i]
        release(margins)
        return None
    for alphas in groups:
        names = [f"t{i}" for i in range(GROUP)]
        table = it.state.select("sign", "w", it.slope.alias("slope"), *[it.step(a).alias(n) for a, n in zip(alphas, names)])
        with_now = ["w", *names] if now is None else names
        margins = _margins(part, table, with_now, n_features)
        losses = margins.agg(*[F.sum(softplus_loss(label, F.col(c))).alias(c) for c in with_now]).first()
        sums = []
        for c in names:
            t = F.col(c)
            sums += [F.sum(t * t).alias(f"{c}2"), F.sum(F.abs(t)).alias(f"{c}1"), F.sum((t - F.col("w")) * F.col("slope")).alias(f"{c}g")]
        row = table.agg(*sums).first()
        if now is None:
            now = _objective(losses["w"] or 0.0, it.ww, it.w1, l1, l2)
        for a, c in zip(alphas, names):
            value = _objective(losses[c] or 0.0, row[f"{c}2"], row[f"{c}1"], l1, l2)
            if value <= now + SUFFICIENT * row[f"{c}g"] + ROUNDING * abs(now):
                return a, margins, F.col(c), now, value
        release(margins)
    return None


def _residuals(margins: DataFrame, z: Column) -> DataFrame:
    return margins.select("instance_id", "label", (1.0 / (1.0 + F.exp(-z))).alias("p"))


def start(part: Part, features: DataFrame, l2: float, weights: DataFrame | None = None) -> DataFrame:
    """The first table: ``sign``, ``w``, the smooth gradient ``g`` and the scale ``h`` of each of the ``features``."""
    if part.packed:
        return _packed_start(part, l2, weights)
    table = features.select("sign").distinct()
    if weights is None:
        table = table.withColumn("w", F.lit(0.0))
        margins = part.tokens.groupBy("instance_id").agg(F.max("label").alias("label"), F.lit(0.0).alias("z"))
        margins = materialize(margins, "margins")
    else:
        table = table.join(weights.select("sign", "w"), "sign", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        margins = _margins(part, weights.withColumnRenamed("w", "z"), ["z"], None)
    gradient = token_gradient(part.tokens, _residuals(margins, F.col("z")), part.n_instances, part.hot, part.colocated)
    table = materialize(table.join(gradient, "sign", "left").select("sign", "w", *_smooth_and_scale(l2)), "state")
    release(margins)
    return table


def _smooth_and_scale(l2: float) -> list[Column]:
    """The smooth gradient and the scale, of the loss's gradient ``g`` and the ``touched`` tokens."""
    curved = F.coalesce(F.col("touched"), F.lit(0)) / 4 + l2  # no instance curves the loss more than this
    smooth = F.coalesce("g", F.lit(0.0)) + l2 * F.col("w")
    return [smooth.alias("g"), F.when(curved > 0, 1 / curved).otherwise(1.0).alias("h")]


def _packed_start(part: Part, l2: float, weights: DataFrame | None) -> DataFrame:
    """As ``start`` over the places of packed tokens; the table has the ``place`` of each sign too."""
    packed = part.packed
    if weights is None:
        table, dense = packed.places.withColumn("w", F.lit(0.0)), np.zeros((1, packed.n_features))
    else:
        table = packed.places.join(weights.select("sign", "w"), "sign", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        dense, _ = packed.vectors(table.where("w <> 0"), F.col("w"))
    with packed.scanned(dense) as found:
        return materialize(table.join(found, "place", "left").select("sign", "place", "w", *_smooth_and_scale(l2)), "state")


def minimise(
    part: Part,
    state: DataFrame,
    l1: float = 0.0,
    l2: float = 0.0,
    max_iter: int = 200,
    tol: float = 1e-5,
    history: int = HISTORY,
    visit: Visit | None = None,
    gain: float = -1.0,
) -> Solution:
    """Iterate from ``state`` until the pseudo-gradient is below ``tol`` times the weights' norm (1 at least).

    ``part`` holds tokens of the state's features only, or packed ones. Each iteration writes one state and
    removes the one before, after ``visit(i, weights)`` has seen the new weights. The state
    that is passed in stays. Over packed tokens only the last state is written, and ``gain`` is
    the share of the objective that a step must gain (on average of the last ``GAINS``) to go on.
    """
    if part.packed:
        return _minimise_packed(part, state, l1, l2, max_iter, tol, history, visit, gain)
    given, found, now, it = state, Solution(state), None, None
    n_features = state.count()
    for i in range(max_iter + 1):
        it = _Iteration(state, l1, it)
        found.state, found.norm = state, it.norm
        if it.norm <= tol * max(1.0, np.sqrt(it.ww)) or i == max_iter:
            break
        step = _search(it, part, l1, l2, now, n_features)
        if step is None:  # nothing below rounding is left
            break
        alpha, margins, z, before, now = step
        if not found.objective:
            found.objective.append(before)
        found.objective.append(now)
        gradient = token_gradient(part.tokens, _residuals(margins, z), part.n_instances, part.hot, part.colocated).select("sign", F.col("g").alias("new"))
        kept = min(len(it.kept) + 1, history)
        moved = state.withColumn("moved", it.step(alpha)).join(gradient, "sign", "left")
        smooth = F.coalesce("new", F.lit(0.0)) + l2 * F.col("moved")
        older = [F.col(f"{c}{j}").alias(f"{c}{j + 1}") for j in range(kept - 1) for c in ("s", "y")]
        moved = moved.select(
            "sign", F.col("moved").alias("w"), smooth.alias("g"), "h", (F.col("moved") - F.col("w")).alias("s0"),
            (smooth - F.col("g")).alias("y0"), *older,
        )
        stepped = materialize(moved, "state")
        release(margins)
        if state is not given:
            release(state)
        state = stepped
        if visit:
            visit(i, stepped.where(F.col("w") != 0).select("sign", "w"))
    return found


def _minimise_packed(
    part: Part, state: DataFrame, l1: float, l2: float, max_iter: int, tol: float, history: int, visit: Visit | None, gain: float
) -> Solution:
    """``minimise`` over packed tokens: the same steps, with the state's columns as arrays and one pass a step."""
    packed, found, now = part.packed, Solution(state), None
    columns, at = packed.vectors(state, F.col("w"), F.col("g"), F.col("h"))
    w, g, h = (c[at] for c in columns)
    among, root, steps, changes = np.zeros(packed.n_features, bool), np.sqrt(h), [], []
    among[at] = True

    def evaluated(trials: list[np.ndarray], gradient: bool = True) -> tuple[list[float], np.ndarray]:
        """The objective at each of the weights, and the smooth gradient at the first."""
        dense = np.zeros((len(trials), packed.n_features))
        dense[:, at] = trials
        losses, slopes = packed.evaluated(dense, gradient, among)
        return [_objective(f, t @ t, np.abs(t).sum(), l1, l2) for f, t in zip(losses, trials)], slopes[at] + l2 * trials[0]

    for i in range(max_iter + 1):
        slope = np.select([(w > 0) | (w == 0) & (g < -l1), (w < 0) | (g > l1)], [g + l1, g - l1], 0.0) if l1 else g
        found.norm = float(np.sqrt(slope @ slope))
        recent = found.objective[-1 - GAINS :]
        slow = len(recent) > GAINS and recent[0] - recent[-1] <= GAINS * gain * abs(recent[-1])
        if found.norm <= tol * max(1.0, np.sqrt(w @ w)) or slow or i == max_iter:
            break
        free = (w != 0) | (slope != 0) if l1 else slice(None)  # what may move: steps of the others tell nothing
        pairs = [(s[free], y[free]) for s, y in zip(steps, changes)]
        pairs = [(s, y) for s, y in pairs if s @ y > 1e-14 * (y @ y)]
        basis = [*[s for s, _ in pairs], *[y for _, y in pairs], (slope * root)[free]]
        by = coefficients(np.array([[a @ b for b in basis] for a in basis]))
        direction = np.zeros(len(w))
        direction[free] = root[free] * sum(factor * a for factor, a in zip(by, basis))
        if l1:  # a weight leaves 0 down the slope only
            direction = np.where((w != 0) | (direction * slope < 0), direction, 0.0)
        side = np.where(w != 0, np.sign(w), -np.sign(slope))

        def stepped(alpha: float) -> np.ndarray:
            moved = w + alpha * direction
            return np.where(np.sign(moved) == side, moved, 0.0) if l1 else moved

        def lower(t: np.ndarray, value: float) -> bool:
            return value <= now + SUFFICIENT * min((t - w) @ slope, 0.0) + ROUNDING * abs(now)

        t = stepped(1.0)
        values, smooth = evaluated([t] if i else [t, w])
        value = values[0]
        if not i:
            now = values[1]
        if not lower(t, value):
            for begin in range(1, TRIALS, GROUP):
                trials = [stepped(0.5**j) for j in range(begin, min(begin + GROUP, TRIALS))]
                values, _ = evaluated(trials, gradient=False)
                t = next((t for t, f in zip(trials, values) if lower(t, f)), None)
                if t is not None:
                    break
            else:
                if not steps:  # nothing below rounding is left
                    break
                steps, changes = [], []  # once more, straight down the slope
                continue
            (value,), smooth = evaluated([t])
        if not found.objective:
            found.objective.append(now)
        found.objective.append(value)
        steps, changes = [*steps, (t - w) / root][-history:], [*changes, (smooth - g) * root][-history:]
        w, g, now = t, smooth, value
        if visit:
            visit(i, packed.table(at, w=w).where(F.col("w") != 0).select("sign", "w"))
    if found.objective:
        found.state = materialize(packed.table(at, w=w, g=g, h=h), "state")
    return found


@dataclass
class Stage:
    """One stage of the path: its l1 term, how many features it fitted and how many had come back."""

    l1: float
    fitted: int
    returned: int


def elastic_path(
    part: Part, features: DataFrame, l1: float, l2: float, solve: Solve, tol: float = 1e-5, ratio: float = RATIO
) -> tuple[DataFrame, list[Stage]]:
    """Weights (the non-zero ones) of the fit at ``l1``, by stages over surviving features only.

    ``solve(part, surviving, goal, last)`` fits the tokens of ``surviving`` (sign, w, g, h)
    to the l1 term ``goal``; its weights outlive those tables. Dropped features have weight
    0, and the check of their pseudo-gradient makes the result that of a fit of all features.
    """
    whole = start(part, features, l2)
    above = whole.agg(F.max(F.abs("g"))).first()[0] or 0.0
    goals = [l1]
    while goals[-1] < ratio * above:
        goals.append(goals[-1] / ratio)
    stages, previous, weights = [], above, None
    for goal in reversed(goals):
        last = goal == l1
        bound = max(2 * goal - previous, 0.0)
        surviving = materialize(whole.where((F.abs("g") >= bound) | (F.col("w") != 0)), "surviving")
        returned = 0
        while True:
            n = surviving.count()
            if part.packed:  # weights of all others are 0 in a pass
                weights = solve(part, surviving, goal, last)
            else:
                tokens = lookup_join(part.tokens, surviving.select("sign"), "sign", "left_semi", right_rows=n, hot=part.hot)
                own = Part(materialize(tokens, "survivors"), part.n_instances, part.hot)
                weights = solve(own, surviving, goal, last)
                release(own.tokens)
            now = start(part, features, l2, weights)
            release(whole)
            whole = now
            if not last:  # what a stage on the way misses, the next one takes in by its gradient
                break
            # The check looks at every feature that the fit never read.
            dropped = whole.join(surviving.select("sign"), "sign", "left_anti")
            slack = max(tol, 1e-9) * goal
            moving = pseudo_gradient(dropped.select("sign", "g"), dropped.select("sign", "w"), goal + slack).where("pg <> 0")
            both = surviving.select("sign").unionByName(moving.select("sign"))
            more = materialize(whole.join(both, "sign", "left_semi"), "surviving")
            back = more.count() - n
            release(surviving)
            surviving = more
            if not back:
                break
            returned += back
        stages.append(Stage(goal, n, returned))
        release(surviving)
        previous = goal
    release(whole)
    return weights, stages


def training_part(instances_tokens: DataFrame, features: DataFrame) -> Part:
    """Tokens of known features with binary labels, written once for all passes.

    They are bucketed by instance: margins need no shuffle, and residuals, a row per instance,
    come to the tokens by a shuffle of their own and never through the driver.
    """
    label = F.when(F.col("label") > 0, 1).otherwise(0).alias("label")  # counts above one are clicks too
    tokens = instances_tokens.select("instance_id", label, "sign")
    kept = lookup_join(tokens, features.select("sign").distinct(), "sign", "left_semi")
    return lay_out(kept, colocate=True).all()
