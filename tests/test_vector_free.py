"""Fits whose vectors stay tables against plain numpy, and against the driver's solver."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.operators.tokens import explode_tokens
from adloom.plans import convex, vector_free
from adloom.workspace import shared_dir

SCHEMA = "instance_id long, shows long, clicks long, label int, feats array<struct<sign: long, slot: int>>"


def made(n=400, features=12, seed=3):
    """Instances with some features, one of them in a third of all, one never seen; labels that depend on them."""
    random = np.random.default_rng(seed)
    truth = random.normal(size=features) * np.r_[np.full(4, 1.5), np.full(features - 4, 0.05)]
    rows, x = [], np.zeros((n, features))
    for i in range(n):
        own = sorted(set(random.integers(1, features, 3).tolist()) | ({0} if i % 3 == 0 else set()))
        if i % 50 == 0:
            own = own[:1] * 2  # a token twice
        for f in own:
            x[i, f] += 1
        label = int(random.random() < 1 / (1 + np.exp(-x[i] @ truth)))
        rows.append((i, 1, label, label * (1 + i % 2), [(f, 1) for f in own]))
    rows.append((n, 1, 1, 1, []))
    return rows, x, np.array([min(r[3], 1) for r in rows[:-1]])


def optimum(x, y, l1, l2, steps=20_000):
    """Proximal gradient steps, to the end."""
    w, big = np.zeros(x.shape[1]), 0.25 * np.linalg.norm(x, 2) ** 2 + l2
    for _ in range(steps):
        u = w - (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + l2 * w) / big
        w = np.sign(u) * np.maximum(np.abs(u) - l1 / big, 0)
    return w


@pytest.fixture(scope="module")
def data(spark):
    rows, x, y = made()
    train = spark.createDataFrame(rows, SCHEMA)
    features = spark.range(x.shape[1] + 1).selectExpr("id AS sign")  # the last one has no token
    return train, features, x, y


def weights_of(fit, n):
    w = np.zeros(n + 1)
    for r in fit.weights.collect():
        w[r["sign"]] = r["w"]
    return w



def listing(spark):
    return set(Path(shared_dir(spark).split(":", 1)[-1], "adloom").iterdir())


def test_l2_fit_shows_each_step_and_leaves_one_table(spark, data):
    train, features, x, y = data
    before, seen = listing(spark), []
    fit = convex.train_lr_l2(train, train, features, theta=2.0, tol=1e-3, resolution=4, on_iteration=lambda i, w: seen.append((i, w.count())))
    assert np.abs(weights_of(fit, 12) - np.r_[optimum(x, y, 0, 2.0), 0]).max() < 2e-3
    history = fit.history.orderBy("iter").collect()
    assert [i for i, _ in seen] == [r["iter"] for r in history] == list(range(len(history)))
    losses = [r["loss"] for r in history]
    assert losses[-1] < losses[0] and all(a >= b - 1e-9 for a, b in zip(fit.objective, fit.objective[1:]))
    assert fit.objective[0] == pytest.approx(np.log(2))
    left = [p.name.split("-")[0] for p in listing(spark) - before]
    assert left.count("weights") == 1 and not {"state", "margins", "tokens"} & set(left)


def test_orthant_steps_reach_the_elastic_optimum(spark, data):
    train, features, x, y = data
    part = vector_free.training_part(explode_tokens(train), features)
    first = vector_free.start(part, features, 0.5)
    found = vector_free.minimise(part, first, l1=4.0, l2=0.5, tol=1e-5)
    want = np.r_[optimum(x, y, 4.0, 0.5), 0]
    got = weights_of(found, 12)
    assert (want == 0).sum() >= 3 and np.abs(got - want).max() < 1e-4 and ((got == 0) == (want == 0)).all()


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_path_fits_survivors_only(spark, data, monkeypatch, limit):
    """With the driver's solver for the survivors, and with none on the driver."""
    train, features, x, y = data
    monkeypatch.setattr(convex, "DRIVER_FEATURES", limit)
    fit = convex.train_lr_elastic(train, train, features, l1=12.0, l2=0.5, tol=1e-9 if limit else 1e-4, solver="path")
    want = np.r_[optimum(x, y, 12.0, 0.5), 0]
    assert np.abs(weights_of(fit, 12) - want).max() < 1e-3
    assert [s.l1 for s in fit.stages][-1] == 12.0 and all(s.fitted < 13 for s in fit.stages)
    assert (want != 0).sum() <= fit.stages[-1].fitted


def test_dropped_features_that_would_move_come_back(spark, data, monkeypatch):
    train, features, x, y = data
    want = np.r_[optimum(x, y, 12.0, 0.5), 0]
    moving = [int(i) for i in np.flatnonzero(want)[:2]]
    written, calls = vector_free.materialize, []

    def forgetful(df, name, *args):
        if name == "surviving" and not calls:  # the screening overlooks two features that matter
            df = df.where(~F.col("sign").isin(moving))
        return written(df, name, *args)

    def solve(own, surviving, goal, last):
        calls.append({r["sign"] for r in surviving.select("sign").collect()})
        return vector_free.minimise(own, surviving, goal, 0.5, tol=1e-4).weights

    monkeypatch.setattr(vector_free, "materialize", forgetful)
    part = vector_free.training_part(explode_tokens(train), features)
    weights, stages = vector_free.elastic_path(part, features, 12.0, 0.5, solve, ratio=0.01)
    got = np.zeros(13)
    for r in weights.collect():
        got[r["sign"]] = r["w"]
    assert np.abs(got - want).max() < 1e-3
    assert not calls[0] & set(moving) and calls[-1] >= set(moving) and stages[-1].returned == len(calls[-1]) - len(calls[0])


def test_without_rows_or_signal(spark, data):
    train, features, *_ = data
    heavy = convex.train_lr_elastic(train, train, features, l1=1e6, l2=1.0, solver="path")
    assert heavy.weights.count() == 0 and len(heavy.stages) == 1
    none = convex.train_lr_l2(train.where("false"), train, features, solver="tables")
    assert none.weights.count() == 0
    with pytest.raises(ValueError):
        convex.train_lr_l2(train, train, features, solver="driver", on_iteration=print)


def test_coefficients_are_the_two_loop_recursion():
    random = np.random.default_rng(0)
    for m in (0, 1, 4):
        s, g = random.normal(size=(m, 9)), random.normal(size=9)
        a = random.normal(size=(9, 9))
        y = s @ (a @ a.T + np.eye(9))
        basis = np.vstack([s, y, g[None]])
        q, along = g.copy(), []
        for i in reversed(range(m)):
            along.append(s[i] @ q / (s[i] @ y[i]))
            q -= along[-1] * y[i]
        if m:
            q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
        for i in range(m):
            q += s[i] * (along[m - 1 - i] - y[i] @ q / (s[i] @ y[i]))
        assert np.allclose(vector_free.coefficients(basis @ basis.T) @ basis, -q)
