from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from adloom.catalog.queries import event_fm, event_tokens
from adloom.operators import factor, metrics
from adloom.plans import fm
from adloom.workspace import materialize, shared_dir

K = 3


def sig(z):
    return 1 / (1 + np.exp(-z))


@pytest.fixture
def toy(spark):
    rows = [(1, 1, 10), (1, 1, 11), (1, 1, 10), (2, 0, 11), (2, 0, 12), (3, 1, 13), (4, 0, 99)]
    t = spark.createDataFrame(
        pd.DataFrame(rows, columns=["instance_id", "label", "sign"]), "instance_id long, label int, sign long"
    )
    model = {10: (0.1, [0.5, -0.2, 0.3]), 11: (-0.3, [0.1, 0.4, 0.2]), 12: (0.2, []), 13: (0.7, [1.0, 1.0, 1.0])}
    frame = spark.createDataFrame([(s, w, v) for s, (w, v) in model.items()], "sign long, w double, v array<double>")
    return t, rows, model, frame


def pairs(rows, model):
    """Margins by spelling out every pair of positions."""
    z, label = {}, {}
    for i in {r[0] for r in rows}:
        feats = [s for a, _, s in rows if a == i and s in model]
        label[i] = next(y for a, y, _ in rows if a == i)
        z[i] = sum(model[s][0] for s in feats)
        for a in range(len(feats)):
            for b in range(a + 1, len(feats)):
                va, vb = model[feats[a]][1], model[feats[b]][1]
                if va and vb:
                    z[i] += float(np.dot(va, vb))
    return z, label


def test_score_spelled_out(toy):
    t, rows, model, frame = toy
    z, _ = pairs(rows, model)
    got = {r.instance_id: r.p for r in factor.score_fm(t, frame, K).collect()}
    assert got == {i: pytest.approx(sig(v)) for i, v in z.items()}


def test_gradient_spelled_out(toy):
    t, rows, model, frame = toy
    z, label = pairs(rows, model)
    g, gv = {}, {}
    for i in z:
        r = sig(z[i]) - label[i]
        feats = [s for a, _, s in rows if a == i and s in model]
        for a, s in enumerate(feats):
            g[s] = g.get(s, 0) + r
            others = np.sum([model[o][1] for b, o in enumerate(feats) if b != a and model[o][1]] or [[0.0] * K], axis=0)
            if model[s][1]:
                gv[s] = gv.get(s, np.zeros(K)) + r * others
    got = {row.sign: (row.g, row.gv) for row in factor.fm_gradient(t, frame, K).collect()}
    assert set(got) == set(g)
    for s in g:
        assert got[s][0] == pytest.approx(g[s])
        assert got[s][1] == (pytest.approx(gv[s].tolist()) if s in gv else [])


def test_curve_equals_direct_scoring(spark, small):
    t = materialize(event_tokens(spark, small), "t")
    model = event_fm(spark, small)
    gradient = factor.fm_gradient(t, model, 4)
    direction = materialize(factor.step_direction(model, gradient, 1 / 100, 4.0), "d")
    curve = factor.margin_curve(t, direction, 4)
    losses = {r.multiplier: r.train_loss for r in factor.step_losses(curve, 1, 99).collect()}
    for m in (1, 7, 99):
        direct = metrics.log_loss(factor.score_fm(t, factor.take_step(direction, m), 4)).first().loss
        assert losses[m] == pytest.approx(direct, rel=1e-9)
    best, trace = factor.search_step(t, direction, 4)
    worse = [m for m in range(2, 100) if losses[m] >= losses[m - 1]]
    assert best == (worse[0] - 1 if worse else 99)
    assert [m for m, _ in trace] == list(range(1, min(best + 1, 99) + 1))


def test_untouched_features_stay_unless_compat(spark, toy):
    _, _, _, frame = toy
    gradient = spark.createDataFrame([(10, 1.0, [1.0, 0.0, 0.0])], "sign long, g double, gv array<double>")
    ours = factor.take_step(factor.step_direction(frame, gradient, 0.1, 4.0), 1)
    got = {r.sign: (r.w, r.v) for r in ours.collect()}
    assert got[10][0] == pytest.approx(0.1 - 0.1 * (1 + 0.4))
    assert got[10][1] == pytest.approx([0.5 - 0.1 * 3, -0.2 + 0.08, 0.3 - 0.12])
    assert got[11] == (-0.3, [0.1, 0.4, 0.2]) and got[12] == (0.2, [])
    compat = factor.take_step(factor.step_direction(frame, gradient, 0.1, 4.0, compat=True), 1)
    (row,) = compat.collect()
    assert row.sign == 10 and row.w == pytest.approx(0.1 - 0.1 * (1 - 0.4))


def test_no_factors_is_logistic_regression(spark, toy):
    t, rows, model, frame = toy
    fit = fm.train_fm(t, t, frame.select("sign"), k=0, rate=1.0, max_iter=1)
    assert all(r.v == [] for r in fit.weights.collect())
    assert fit.trace.count() >= 1


def test_vector_sums(spark):
    rows = [("a", [1.0, 2.0]), ("a", []), ("a", [3.0, 4.0]), ("b", [])]
    got = {r.key: r.v for r in factor.sum_vectors(spark.createDataFrame(rows, "key string, v array<double>"), "key", "v", 2).collect()}
    assert got == {"a": [4.0, 6.0], "b": []}


def test_hashed_starts_do_not_collide(spark):
    signs = spark.createDataFrame([(5,), (1000008,), (6,)], "sign long")
    v = {r.sign: r.v for r in fm.init_model(signs, 4, 0.001).collect()}
    assert all(0 <= x < 0.001 for row in v.values() for x in row) and len({x for row in v.values() for x in row}) == 12
    wide = {int(r.sign): r.v for r in fm.init_model(signs.selectExpr("cast(sign AS decimal(20,0)) AS sign"), 4, 0.001).collect()}
    assert wide == v
    same = {r.sign: r.v for r in fm.init_model(signs, 4, 0.001, arithmetic=True).collect()}
    assert same[5] == same[1000008]


def test_fm_loop_keeps_its_last_model_alone(spark, toy):
    t, frame = materialize(toy[0], "toy"), toy[3].select("sign")
    folder = Path(shared_dir(spark)) / "adloom"
    before = len(list(folder.iterdir()))
    fit = fm.train_fm(t, t, frame, k=2, rate=1.0, max_iter=3)
    assert len(list(folder.iterdir())) == before + 1 and fit.weights.count() == 4


def test_random_start_is_in_range(spark, toy):
    start = fm.init_model(toy[3], 8, 0.001, seed=3).collect()
    assert all(0 <= x < 0.001 for r in start for x in r.v) and len({x for r in start for x in r.v}) > 20
