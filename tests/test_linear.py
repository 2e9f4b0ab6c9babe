from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adloom.catalog.queries import event_weights, kept_signs
from adloom.operators import linear, metrics, tokens
from adloom.operators.ranking import dense_index
from adloom.plans import convex, gd
from adloom.plans.training import stalled
from adloom.sources.tables import event_instances
from adloom.workspace import materialize, shared_dir


def toks(spark, rows):
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["instance_id", "label", "sign"]), "instance_id long, label int, sign long"
    )


def wts(spark, d):
    return spark.createDataFrame([(int(k), float(v)) for k, v in d.items()], "sign long, w double")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def sig(z):
    return 1 / (1 + np.exp(-z))


ROWS = [(1, 1, 10), (1, 1, 10), (1, 1, 11), (2, 0, 10), (2, 0, 12)]


def test_scores_clamp_and_repeat(spark):
    got = {r.instance_id: r.p for r in linear.score_linear(toks(spark, ROWS), wts(spark, {10: 0.5, 12: 40.0})).collect()}
    assert got[1] == pytest.approx(sig(1.0)) and got[2] == 1.0


def test_both_step_forms_on_repeats(spark):
    t, w = toks(spark, ROWS), wts(spark, {10: 0.2, 99: 1.0})
    r1, r2 = sig(0.4) - 1, sig(0.2)
    got = as_dict(gd.gd_step(t, w, 2, learning_rate=0.5, theta=4.0))
    assert got[10] == pytest.approx(0.2 - 0.25 * (2 * r1 + r2 + 4 * 0.2))
    assert got[11] == pytest.approx(-0.25 * r1)
    assert got[99] == 1.0  # untouched
    got = as_dict(gd.gd_step(t, w, 2, 0.5, 4.0, mode="per_instance", n_expected=4.0))
    assert got[10] == pytest.approx(0.2 - 0.125 * (r1 + r2 + 2 * 1.0 * 0.2))
    compat = as_dict(gd.gd_step(t, w, 2, 0.5, 4.0, compat=True))
    assert compat[10] == pytest.approx(0.2 - 0.25 * (2 * r1 + r2 - 4 * 0.2))


def test_gradient_is_the_slope_of_the_objective(spark, small):
    inst = event_instances(spark, small)
    t = materialize(tokens.explode_tokens(inst), "t")
    w = as_dict(event_weights(spark, small))
    dictionary = dense_index(t, "sign")
    _, gradient = linear.loss_and_gradient(t, wts(spark, w), dictionary, l2=4.0, mean=True)
    g = {r.sign: r.g for r in gradient.collect()}
    h = 1e-4
    for sign in sorted(w)[::60]:
        def at(x):
            moved = wts(spark, {**w, sign: w[sign] + x})
            return linear.objective(linear.score_linear(t, moved), moved, l2=4.0, mean=True).first().objective
        assert (at(h) - at(-h)) / (2 * h) == pytest.approx(g[sign], abs=1e-6)


@pytest.mark.parametrize("l1,l2", [(0.0, 4.0), (4.0, 0.0), (3.0, 5.0)])
def test_fits_are_optimal(spark, small, l1, l2):
    inst = materialize(event_instances(spark, small), "inst")
    t = tokens.explode_tokens(inst)
    signs = t.select("sign").distinct()
    fit = convex.train_lr_elastic(inst, inst, signs, l1=l1, l2=l2, tol=1e-10)
    dictionary = dense_index(t, "sign")
    _, gradient = linear.loss_and_gradient(t, fit.weights, dictionary, l2=l2)
    slope = linear.pseudo_gradient(gradient, fit.weights, l1).agg(F.max(F.abs("pg"))).first()[0]
    assert slope < 0.02
    n = inst.count()
    value = linear.objective(linear.score_linear(t, fit.weights), fit.weights, l1, l2, mean=True).first()[0]
    assert value == pytest.approx(fit.objective[-1], abs=1e-9)
    assert fit.history.first().n_sampled == n
    if l1:
        assert fit.weights.count() < signs.count()
    if l1 == 0:
        same = convex.train_lr_l2(inst, inst, signs, theta=l2, tol=1e-10)
        assert same.objective[-1] == pytest.approx(fit.objective[-1], abs=1e-12)


def test_gd_loop_lowers_loss_saves_and_stops(spark, small):
    t = tokens.explode_tokens(event_instances(spark, small))
    seen = []
    fit = gd.train_lr_gd(t, t, rate=1.0, max_iter=4, on_iteration=lambda i, w: seen.append((i, w.count())))
    losses = [r.loss for r in fit.history.orderBy("iter").collect()]
    assert losses == sorted(losses, reverse=True) and [i for i, _ in seen] == [0, 1, 2, 3]


def written_tables(spark):
    folder = Path(shared_dir(spark)) / "adloom"
    return {p.name.rsplit("-", 1)[0] for p in folder.iterdir()}, len(list(folder.iterdir()))


@pytest.mark.parametrize("shuffled", [False, True])
def test_gd_loop_keeps_its_last_weights_alone(spark, small, shuffled, request):
    if shuffled:
        request.getfixturevalue("no_broadcast")
    t = materialize(tokens.explode_tokens(event_instances(spark, small)), "input")
    before = written_tables(spark)[1]
    fit = gd.train_lr_gd(t, t, rate=0.5, max_iter=3)
    assert written_tables(spark)[1] == before + 1 and fit.weights.count() > 0
    seen = []
    gd.train_lr_gd(t, t, rate=0.5, max_iter=2, on_iteration=lambda i, w: seen.append(w))
    assert written_tables(spark)[1] == before + 3 and all(w.count() for w in seen)
    gd.train_lr_gd(t.where("false"), t, rate=1.0, max_iter=1).weights.count()


def test_stopping_rule():
    assert not stalled([10, 9, 8, 7, 6, 5], 1e-4)
    assert stalled([5.0] * 6, 1e-4)
    assert not stalled([5.0] * 5, 1e-4)
    assert not stalled([5.0] * 9, None)


def test_sampling_covers_everything_once(spark, small):
    inst = event_instances(spark, small)
    parts = [tokens.sample_instances(inst, 0.25, seed=i).select("instance_id") for i in range(4)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert sorted(r[0] for r in union.collect()) == sorted(r[0] for r in inst.select("instance_id").collect())
    assert all(180 < p.count() < 320 for p in parts)
    drawn = tokens.sample_instances(inst, 0.25, seed=1, mode="bernoulli").count()
    assert 150 < drawn < 350


def test_filter_is_idempotent(spark, small):
    inst = event_instances(spark, small)
    keep = materialize(tokens.frequent_features(tokens.feature_stat(tokens.explode_tokens(inst)), 20), "keep")
    once = materialize(tokens.filter_instances(inst, keep), "once")
    twice = tokens.filter_instances(once, keep)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert kept_signs(spark, small).count() <= keep.count()


def test_batches_count_rows_that_share_an_id(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) AS instance_id")
    got = tokens.assign_batches(rows, 64).toPandas()
    assert sorted(got.groupby("batch").size()) == [40] + [64] * 15
    ids = sorted((r[0] for r in rows.collect()), key=lambda x: (x is not None, x))
    want = [(x, n // 64) for n, x in enumerate(ids)]
    key = lambda p: (p[0] is not None, *p) if p[0] is not None else (False, 0, p[1])
    assert sorted(((r["instance_id"], r["batch"]) for r in tokens.assign_batches(rows, 64).collect()), key=key) == sorted(want, key=key)


def test_batches(spark, small):
    inst = event_instances(spark, small)
    sizes = [r["count"] for r in tokens.assign_batches(inst, 300).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [300, 300, 300, 100]
    local = tokens.local_batches(tokens.shuffle_instances(inst, 3, 4), 64)
    per = local.groupBy("partition", "batch").count().collect()
    full = {}
    for row in per:
        full.setdefault(row.partition, []).append((row.batch, row["count"]))
    assert sum(c for v in full.values() for _, c in v) == 1000
    for v in full.values():
        assert all(c == 64 for _, c in sorted(v)[:-1])


def test_shuffle_is_seeded(spark, small):
    inst = event_instances(spark, small)
    def order(seed):
        return [r.instance_id for r in tokens.shuffle_instances(inst, seed, 1).collect()]
    assert order(1) == order(1) != order(2)


def test_observed_metrics_on_separable_data(spark):
    rows = [(i, i % 2, 10 + i % 2) for i in range(200)]
    t = toks(spark, rows)
    fit = gd.train_lr_gd(t, t, theta=0.0, rate=1.0, max_iter=2)
    assert metrics.auc(linear.score_linear(t, fit.weights)).first().auc == 1.0
