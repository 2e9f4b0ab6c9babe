"""Packed tokens against plain numpy, and fits over them against fits over tables."""

import numpy as np
import pyarrow as pa
import pytest

from adloom.plans import convex, packed, vector_free

FEATS = "instance_id long, shows long, clicks long, label int, feats array<struct<sign: long, slot: int>>"


def groups(n=600, sizes=(4, 7, 30), seed=1):
    """Instances with one feature of each group, so that shifts between groups change no score."""
    random = np.random.default_rng(seed)
    starts = np.cumsum([0, *sizes[:-1]])
    own = np.stack([s + random.integers(0, k, n) for s, k in zip(starts, sizes)], 1)
    x = np.zeros((n, sum(sizes)))
    np.add.at(x, (np.arange(n)[:, None], own), 1.0)
    y = (random.random(n) < 1 / (1 + np.exp(1 - x @ random.normal(size=sum(sizes))))).astype(int)
    return [(i, 1, int(y[i]), int(y[i]), [(int(f), 1) for f in own[i]]) for i in range(n)], x, y


@pytest.fixture(scope="module")
def data(spark):
    rows, x, y = groups()
    train = spark.createDataFrame(rows, FEATS)
    return train, spark.range(x.shape[1]).selectExpr("id AS sign"), x, y


def vector(fit, n):
    w = np.zeros(n)
    for r in fit.weights.collect():
        w[r["sign"]] = r["w"]
    return w


def pseudo(x, y, w, l1, l2):
    g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + l2 * w
    return np.where(w != 0, g + l1 * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - l1, 0))


@pytest.mark.parametrize("most", [3, 1 << 19])
def test_blocks_keep_instances_whole(monkeypatch, most):
    monkeypatch.setattr(packed, "BLOCK_TOKENS", most)
    ids = [None, None, 1, 1, 1, 1, 1, 1, 1, 2, 5, 5, 9]
    labels, places = [0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0], list(range(13))
    table = pa.table({"instance_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32()), "place": pa.array(places, pa.int32())})
    batches = table.to_batches(2)
    found = [b.to_pylist()[0] for b in packed.pack(iter([batches[0].slice(0, 0), *batches]))]
    sizes = np.concatenate([np.frombuffer(b["sizes"], "<i4") for b in found])
    assert sizes.tolist() == [2, 7, 1, 2, 1] and sum(b["n"] for b in found) == 5
    assert b"".join(b["labels"] for b in found) == bytes([0, 1, 1, 0, 0])
    assert np.concatenate([np.frombuffer(b["places"], "<i4") for b in found]).tolist() == places
    assert len(found) > 1 or most > 13


def test_a_pass_gives_losses_and_gradient(data):
    _, _, x, y = data
    own = np.nonzero(x)[1].astype("<i4")
    row = {"n": len(y), "labels": y.astype("<i1").tobytes(), "sizes": np.full(len(y), 3, "<i4").tobytes(), "places": own.tobytes()}
    trials = np.random.default_rng(0).normal(size=(2, x.shape[1])) * 300  # margins far beyond where exp overflows
    out = next(packed.pass_blocks([pa.RecordBatch.from_pylist([row], packed.SCHEMA)], trials, None, True)).to_pydict()
    got = dict(zip(out["place"], out["g"]))
    z = trials @ x.T
    assert np.allclose([got[-1], got[-2]], (np.logaddexp(0, z) - y * z).sum(1))
    p = 0.5 * (1 + np.tanh(z[0] / 2))
    assert np.allclose([got[f] for f in range(x.shape[1])], x.T @ (p - y))
    assert dict(zip(out["place"], out["touched"]))[0] == x[:, 0].sum()


def test_l2_fit_needs_few_jobs_a_step(spark, data, monkeypatch):
    train, features, x, y = data
    context, fits, jobs = spark.sparkContext, [], []
    for plain in (False, True):
        if plain:
            monkeypatch.setattr(convex, "packed_part", lambda *_: None)
        context.setJobGroup(f"fit {plain}", "fit")
        fits.append(convex.train_lr_l2(train, train, features, theta=0.5, tol=1e-4, max_iter=12, resolution=4, solver="tables"))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit {plain}")))
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < 0.5 * jobs[1]
    assert np.abs(vector(fits[0], x.shape[1]) - vector(fits[1], x.shape[1])).max() < 1e-6
    assert fits[0].objective == pytest.approx(fits[1].objective, rel=1e-9)


def test_path_reads_packed_tokens_and_ends_at_the_optimum(spark, data, monkeypatch):
    train, features, x, y = data
    written = []
    for module in (convex, vector_free):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, *a, plain=plain: written.append(name) or plain(df, name, *a))
    fit = convex.train_lr_elastic(train, train, features, l1=6.0, l2=0.05, tol=1e-13, solver="path", resolution=4)
    w = vector(fit, x.shape[1])
    assert not {"survivors", "rows"} & set(written) and len(fit.stages) > 2  # no stage copies the tokens
    assert np.abs(pseudo(x, y, w, 6.0, 0.05)).max() < 1e-2 and 0 < (w != 0).sum() < x.shape[1]
    assert fit.objective[-1] == pytest.approx((np.logaddexp(0, x @ w) - y * (x @ w)).sum() / len(y) + (0.025 * w @ w + 6 * np.abs(w).sum()) / len(y))


def test_many_features_and_hot_instances_are_not_packed(spark, no_broadcast, data):
    from adloom.operators.tokens import explode_tokens

    train, features, *_ = data
    assert packed.packed_part(explode_tokens(train), features) is None
    spark.conf.unset("spark.adloom.broadcastBytes")
    hot = spark.range(12_000).selectExpr("0L AS instance_id", "1 AS label", "id % 9 AS sign")
    assert packed.packed_part(hot, spark.range(9).selectExpr("id AS sign")) is None
