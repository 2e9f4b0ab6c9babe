"""Whitening against a dense eigendecomposition of the same integer vectors."""

import math

import numpy as np
import pytest

from adloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "c") for i, v in rows], SCHEMA)


def plain(vectors, k):
    """Whole vectors, exact deviations, eigenvalues and vectors of the covariance, trace."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    exact = n * x - s
    deviation = [sum(int(e) ** 2 for e in row) for row in exact]
    centred = exact / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    return deviation, centred, e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def compare(got, rows, k):
    rows = [(i, v) for i, v in rows]
    deviation, centred, e, q, trace = plain([v for _, v in rows], k)
    assert len(got) == len(rows) * k
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    whitened = np.zeros((len(rows), k))
    for at, (i, _) in enumerate(rows):
        own = sorted(by_id[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, k + 1))
        for j, r in enumerate(own):
            assert r["n"] == len(rows) and r["deviation"] == deviation[at]
            assert r["explained"] == pytest.approx(e[j] / trace, rel=1e-10, abs=1e-13)
            assert r["identity_error"] < 1e-9
            whitened[at, j] = r["whitened"]
    want = centred @ q / np.sqrt(e)
    for j in range(k):
        sign = np.sign(want[:, j] @ whitened[:, j])
        assert np.allclose(whitened[:, j] * sign, want[:, j], atol=1e-7)


def test_is_the_dense_decomposition(spark):
    random = np.random.default_rng(2)
    x = (random.normal(size=(900, 20)) * np.linspace(1, 0.2, 20)) @ np.linalg.qr(random.normal(size=(20, 20)))[0]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    odd = [(None, None), (5000, []), (5001, [float("nan")] * 20), (5002, [None] + [1.0] * 19), (5003, [float("inf")] * 20)]
    made = frame(spark, rows + odd).repartition(5)
    compare(whitening.whiten(made).collect(), rows, 8)


def test_the_query_on_the_small_tables(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    compare(queries.op13_whitening(spark, small).collect(), rows, 8)


def test_edge_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None),
    ]
    # Three components of rank one, repeated rows, a null id, and vectors of another length.
    rows = [(1, [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (None, [1.0, 2.0, 2.0]), (4, [1.0, 2.0, 2.0]), (9, [3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * 3 + 1
    firsts = [r for r in got if r["n"] == 4 and r["component"] == 1]
    assert sorted(abs(r["whitened"]) for r in firsts) == pytest.approx([1, 1, 1, 1])
    assert all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-12 for r in firsts)
    assert all(r["whitened"] is None for r in got if r["component"] > 1 or r["n"] == 1)
    assert {r["deviation"] for r in firsts} == {4 * 1024**2 * 9}


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whiten(frame(spark, [(1, [3e8]), (2, [-3e8]), (3, [0.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 0}


@pytest.mark.parametrize("dim,kind", [(1, "plain"), (7, "plain"), (64, "plain"), (150, "falling"), (64, "repeated"), (40, "low rank"), (30, "zero")])
def test_leading_pairs(dim, kind):
    random = np.random.default_rng(dim)
    q = np.linalg.qr(random.normal(size=(dim, dim)))[0]
    rest = max(dim - 26, 0)
    spread = {
        "plain": random.random(dim) + 0.5, "falling": 0.95 ** np.arange(dim), "repeated": np.r_[[5.0] * 6, [2.0] * 20, [1.0] * rest],
        "low rank": np.r_[[3.0, 2.0, 2.0], np.zeros(max(dim - 3, 0))], "zero": np.zeros(dim),
    }[kind]
    a = (q * spread) @ q.T
    values, vectors = whitening.leading(lambda b: a @ b, dim, 8)
    assert np.allclose(values, np.sort(spread)[::-1][:8], atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(values.max(), 1e-300) + 1e-300
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13


def test_corrections_solve_the_projected_equation():
    random = np.random.default_rng(1)
    dim = 30
    q = np.linalg.qr(random.normal(size=(dim, dim)))[0]
    a = (q * np.linspace(1, 4, dim)) @ q.T
    locked = q[:, -2:]
    u = np.linalg.qr(np.hstack([locked, random.normal(size=(dim, 3))]))[0][:, 2:]
    theta = (u * (a @ u)).sum(0)
    r = a @ u - u * theta
    r -= locked @ (locked.T @ r)
    t = whitening.corrections(lambda b: a @ b, locked, u, theta, r, 60)
    for j in range(3):
        p = np.eye(dim) - locked @ locked.T - np.outer(u[:, j], u[:, j])
        assert np.allclose(p @ (a - theta[j] * np.eye(dim)) @ p @ t[:, j], -p @ r[:, j], atol=1e-9)
