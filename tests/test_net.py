import numpy as np
import pandas as pd
import pytest

from adloom.functions import layers
from adloom.operators import metrics
from adloom.plans import net as nets


@pytest.fixture
def slots(spark):
    return spark.createDataFrame([(5, 0, 3), (6, 1, 2)], "slot int, slot_idx int, n_feats int")


def data(spark, n=600, seed=0):
    """The label depends on whether position 0 or 5 is active."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        idx = sorted({int(rng.integers(0, 4)), int(rng.integers(4, 7))})
        rows.append((i, int(0 in idx or 5 in idx), idx))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["instance_id", "label", "idx"]), "instance_id long, label int, idx array<int>")


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_gradient_by_finite_difference(slots, mode):
    net = nets.new_net(slots, mode, hidden=(5, 4, 3), embedding=2, seed=1)
    net.params = {name: value.astype(float) for name, value in net.params.items()}
    rows, flat = layers.flatten(pd.Series([[0, 5], [2], [1, 3, 6]]))
    y = np.array([1.0, 0.0, 1.0])
    _, g = layers.gradients(net.slot_of, net.params, rows, flat, y)
    for name, value in net.params.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        def loss(h):
            moved = {**net.params, name: value.copy()}
            moved[name][at] += h
            return layers.gradients(net.slot_of, moved, rows, flat, y)[0] / 3
        assert (loss(1e-6) - loss(-1e-6)) / 2e-6 == pytest.approx(g[name][at], abs=1e-6)


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_folding_the_linear_layers(spark, slots, mode):
    net = nets.new_net(slots, mode, hidden=(8, 6, 4), seed=2)
    df = data(spark, 50)
    local = df.toPandas()
    rows, flat = layers.flatten(local["idx"])
    a, _ = layers.first_layer(net.slot_of, net.params, rows, flat, len(local))
    h = np.maximum(a, 0)
    for i in range(2, 5):
        h = h @ net.params[f"w{i}"] + net.params[f"b{i}"]
    want = dict(zip(local["instance_id"], 1 / (1 + np.exp(-h[:, 0]))))
    got = {r.instance_id: r.p for r in nets.score_dnn(df, net).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_one_partition_equals_plain_training(spark, slots):
    net = nets.new_net(slots, hidden=(6, 4), seed=3)
    df = data(spark, 200).coalesce(1)
    trained, loss = nets.train_epoch(df, net, 0.01, batch=64)
    local = df.toPandas()
    params, adam, total = dict(net.params), layers.Adam(0.01), 0.0
    for start in range(0, 200, 64):
        part = local.iloc[start:start + 64]
        rows, flat = layers.flatten(part["idx"])
        batch_loss, g = layers.gradients(net.slot_of, params, rows, flat, part["label"].to_numpy(np.float32))
        adam.step(params, g)
        total += batch_loss
    assert loss == pytest.approx(total / 200, rel=1e-6)
    for name in params:
        np.testing.assert_allclose(trained.params[name], params[name], atol=1e-6)


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_active_rows_give_the_whole_matrix(slots, mode):
    """Steps on the rows seen so far, and of the whole matrix, agree; moments follow the rows."""
    net = nets.new_net(slots, mode, hidden=(6, 4), seed=3)
    batches = [[[0, 5], [0]], [[2, 5], []], [[0, 6], [2]], [[], []]]
    whole, dense = dict(net.params), layers.Adam(0.05)
    active, sparse = layers.ActiveRows(net.slot_of, net.params), layers.Adam(0.05)
    for idx in batches:
        rows, flat = layers.flatten(pd.Series(idx))
        y = np.array([1.0, 0.0], np.float32)
        dense.step(whole, layers.gradients(net.slot_of, whole, rows, flat, y)[1])
        places = active.take_in(flat, sparse.m, sparse.s)
        sparse.step(active.params, layers.gradients(active.slot_of, active.params, rows, places, y, active.n_slots)[1])
    assert sorted(active.rows) == [0, 2, 5, 6] and sparse.m[active.name].shape[0] == 4
    for name, value in active.params.items():
        np.testing.assert_allclose(value, whole[name][active.all_rows(name, len(value))], atol=1e-6)
    untouched = [1, 3, 4]
    np.testing.assert_array_equal(whole[active.name][untouched], net.params[active.name][untouched])


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_a_step_over_all_rows_is_that_of_one_process(spark, slots, mode):
    net = nets.new_net(slots, mode, hidden=(6, 4), seed=3)
    df = data(spark, 300).repartition(5)
    local = df.toPandas()
    rows, flat = layers.flatten(local["idx"])
    params, adam, got, moments = dict(net.params), layers.Adam(0.01), net, None
    for _ in range(3):
        loss, g = layers.gradients(net.slot_of, params, rows, flat, local["label"].to_numpy(np.float32))
        adam.step(params, g)
        got, moments, mean = nets.train_step(df, got, moments, 0.01, batch=64)
        assert mean == pytest.approx(loss / 300, rel=1e-5)
    for name in params:
        np.testing.assert_allclose(got.params[name], params[name], atol=2e-4)
    with pytest.raises(ValueError):
        nets.train_step(df.where("false"), net)


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_training_learns(spark, slots, mode):
    saved = []
    fit = nets.train_dnn(
        data(spark), data(spark, 200, seed=9), slots, mode, hidden=(16, 8), epochs=6, learning_rate=0.02,
        batch=32, partitions=2, on_iteration=lambda i, w: saved.append(w.count()),
    )
    history = fit.history.orderBy("iter").collect()
    assert history[-1].loss < history[0].loss * 0.6 and history[-1].auc > 0.9
    assert len(saved) == 6 and fit.weights.select("layer").distinct().count() == len(fit.net.params)
    assert metrics.auc(nets.score_dnn(data(spark, 200, seed=9), fit.net)).first().auc > 0.9


def test_an_instance_without_known_features_is_scored(spark, slots):
    df = spark.createDataFrame([(1, 0, []), (2, 1, [0])], "instance_id long, label int, idx array<int>")
    for mode in ("embedding", "discrete"):
        net = nets.new_net(slots, mode, hidden=(4, 3))
        u, c = nets.fold(net)
        z = np.maximum(net.params["b1"][0], 0) @ u + c
        got = {r.instance_id: r.p for r in nets.score_dnn(df, net).collect()}
        assert got[1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        nets.train_epoch(df, net)


def test_minibatches_cross_frames():
    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 5), (5, 6), (6, 17))]
    sizes = [len(b) for b in layers.minibatches(iter(frames), 4)]
    assert sizes == [4, 4, 4, 4, 1]


class Counted(np.ndarray):
    """A matrix that counts the multiplications it takes part in."""

    work = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        plain = [np.asarray(x) if isinstance(x, Counted) else x for x in inputs]
        if ufunc is np.matmul:
            Counted.work += plain[0].shape[0] * plain[0].shape[1] * plain[1].shape[1]
        return getattr(ufunc, method)(*plain, **options)


def test_linear_layers_are_passed_once_a_batch():
    rng = np.random.default_rng(0)
    p = {"w1": rng.normal(size=(9, 8)), "b1": np.ones((1, 8)), "w2": rng.normal(size=(8, 5)).view(Counted), "b2": np.ones((1, 5)),
         "w3": rng.normal(size=(5, 1)), "b3": np.ones((1, 1))}
    rows, flat = np.arange(200), rng.integers(0, 9, 200)
    layers.gradients(np.zeros(9, int), p, rows, flat, rng.integers(0, 2, 200).astype(float))
    assert Counted.work <= 2 * 8 * 5
