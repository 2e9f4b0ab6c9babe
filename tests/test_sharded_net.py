import numpy as np
import pandas as pd
import pytest
from test_net import data, slots  # noqa: F401  (a fixture)

from adloom.functions import layers
from adloom.operators import metrics
from adloom.plans import net as nets
from adloom.plans import sharded_net as sharded
from adloom.workspace import shared_dir


def values(table, column="v"):
    """Arrays by layer, rows in order."""
    got = table.params.toPandas().sort_values(["layer", "row"])
    return {name: np.stack(part[column].to_list()) for name, part in got.groupby("layer")}


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_a_step_is_that_of_one_process(spark, slots, mode):  # noqa: F811
    net = nets.new_net(slots, mode, hidden=(6, 4), embedding=2, seed=3)
    df = data(spark, 300).repartition(5)
    local = df.toPandas()
    rows, flat = layers.flatten(local["idx"])
    params, adam = dict(net.params), layers.Adam(0.01)
    table, laid = sharded.as_table(spark, net), sharded.lay_rows(df)
    for _ in range(3):
        loss, g = layers.gradients(net.slot_of, params, rows, flat, local["label"].to_numpy(np.float32))
        adam.step(params, g)
        table, mean = sharded.train_step(laid, table, 4, 0.01, batch=64)
        assert mean == pytest.approx(loss / 300, rel=1e-5)
    got = values(table)
    for name in params:
        np.testing.assert_allclose(got[name], params[name], atol=2e-4)
    with pytest.raises(ValueError):
        sharded.train_step(sharded.lay_rows(df.where("false")), table)


def test_moments_exist_for_rows_that_were_named(spark, slots):  # noqa: F811
    """Rows that no instance names keep their values; a row once named moves on by its moments."""
    rows = lambda idx: sharded.lay_rows(spark.createDataFrame([(1, 1, idx)], "instance_id long, label int, idx array<int>"))
    net = nets.new_net(slots, hidden=(4, 3), seed=1)
    one, _ = sharded.train_step(rows([0, 5]), sharded.as_table(spark, net), 2, 0.05)
    two, _ = sharded.train_step(rows([2]), one, 2, 0.05)
    held = {r.row for r in two.params.where("layer = 'emb' and m is not null").collect()}
    assert held == {0, 2, 5} and two.steps == 2
    a, b, c = net.params["emb"], values(one)["emb"], values(two)["emb"]
    np.testing.assert_array_equal(c[[1, 3, 4]], a[[1, 3, 4]].astype(float))
    np.testing.assert_array_equal(b[2], a[2].astype(float))
    assert (c[[0, 5]] != b[[0, 5]]).all() and (c[2] != b[2]).all()


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
@pytest.mark.parametrize("parts", [1, 3])
def test_an_epoch_averages_plain_training_of_each_part(spark, slots, mode, parts):  # noqa: F811
    net = nets.new_net(slots, mode, hidden=(6, 4), seed=3)
    laid = sharded.lay_rows(data(spark, 200))
    table = sharded.as_table(spark, net)
    trained, loss = sharded.train_epoch(laid, table, parts, 7, 0.01, batch=32)
    order = laid.selectExpr("xxhash64(at, 7) o", "label", "idx").toPandas().sort_values("o")
    total, mean = 0.0, {name: np.zeros(v.shape) for name, v in net.params.items()}
    for part in range(parts):
        mine = order[order["o"] % parts == part]
        params, adam = dict(net.params), layers.Adam(0.01)
        for at in range(0, len(mine), 32):
            batch = mine.iloc[at:at + 32]
            rows, flat = layers.flatten(batch["idx"])
            batch_loss, g = layers.gradients(net.slot_of, params, rows, flat, batch["label"].to_numpy(np.float32))
            adam.step(params, g)
            total += batch_loss
        for name in params:
            mean[name] += (params[name] - net.params[name]) * len(mine) / 200
    got = values(trained)
    assert loss == pytest.approx(total / 200, rel=1e-5)
    for name, change in mean.items():
        np.testing.assert_allclose(got[name], net.params[name] + change, atol=1e-5)


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_scores_equal_those_of_the_whole_net(spark, slots, mode):  # noqa: F811
    net = nets.new_net(slots, mode, hidden=(8, 6, 4), seed=2)
    rows = [(None, 0, [0]), (None, 1, [0]), (1, 0, []), (1, 1, None), (2, 0, [2, 4, 6])]
    df = data(spark, 50).unionByName(spark.createDataFrame(rows, "instance_id long, label int, idx array<int>"))
    laid = sharded.lay_rows(df)
    want = sorted((r.instance_id or -1, r.label, round(r.p, 6)) for r in nets.score_dnn(laid, net).collect())
    for parts in (1, 4):
        got = sharded.score(laid, sharded.as_table(spark, net), parts).collect()
        assert sorted((r.instance_id or -1, r.label, round(r.p, 6)) for r in got) == want
    none = sharded.score(sharded.lay_rows(df.where("idx is null")), sharded.as_table(spark, net), 2)
    assert none.count() == 1  # a part without a single feature
    assert sharded.score(sharded.lay_rows(df.where("false")), sharded.as_table(spark, net), 2).count() == 0


def test_a_hot_id_spreads_over_the_parts(spark, slots):  # noqa: F811
    df = spark.range(4000).selectExpr("if(id % 3 = 0, null, id) instance_id", "0 label", "array(0) idx")
    dealt = sharded._dealt(sharded.lay_rows(df), sharded.as_table(spark, nets.new_net(slots, hidden=(4,))), 8, 0)
    sizes = [r[1] for r in dealt.where("kind = 1").selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600 and sum(sizes) == 4000


def test_an_unknown_position_raises(spark, slots):  # noqa: F811
    table = sharded.as_table(spark, nets.new_net(slots, hidden=(4,)))
    df = spark.createDataFrame([(1, 0, [99])], "instance_id long, label int, idx array<int>")
    with pytest.raises(Exception, match="no row for"):
        sharded.score(sharded.lay_rows(df), table, 1).collect()


def test_start_values(spark):
    slots = spark.createDataFrame([(5, 0, 999), (6, 1, 1999)], "slot int, slot_idx int, n_feats int")
    table = sharded.hashed_net(slots, hidden=(16, 8), embedding=4, seed=5)
    got = values(table)
    assert list(table.starts) == [0, 1000]
    assert {n: v.shape for n, v in got.items()} == {
        "emb": (3000, 4), "w1": (8, 16), "b1": (1, 16), "w2": (16, 8), "b2": (1, 8), "w3": (8, 1), "b3": (1, 1)}
    emb = got["emb"]
    assert abs(emb).max() <= 0.2 and abs(emb.mean()) < 0.005 and 0.07 < emb.std() < 0.1
    assert len(np.unique(emb)) == emb.size and (got["b1"] == nets.START_BIAS).all()


@pytest.mark.parametrize("mode", ["embedding", "discrete"])
def test_training_learns_and_deletes_its_tables(spark, slots, mode):  # noqa: F811
    from pathlib import Path

    before = set(Path(shared_dir(spark), "adloom").glob("*"))
    fit = sharded.train_dnn(
        data(spark), data(spark, 200, seed=9), slots, mode, hidden=(16, 8), epochs=4, learning_rate=0.02, batch=32, parts=2)
    history = fit.history.orderBy("iter").collect()
    assert history[-1].loss < history[0].loss * 0.7 and history[-1].auc > 0.9
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(shared_dir(spark), "adloom").glob("*")) - before}
    assert left == {"net"}
    held_out = sharded.lay_rows(data(spark, 200, seed=9))
    assert metrics.auc(sharded.score(held_out, fit.net)).first().auc == pytest.approx(history[-1].auc)


def test_only_the_loss_reaches_the_driver(spark, slots, monkeypatch):  # noqa: F811
    """Neither the net nor its changes are collected or broadcast."""
    laid, table = sharded.lay_rows(data(spark, 100)), sharded.as_table(spark, nets.new_net(slots, hidden=(4,)))
    def refuse(*_, **__):
        raise AssertionError("the net left the tasks")
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", refuse)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", refuse)
    monkeypatch.setattr("pyspark.core.context.SparkContext.broadcast", refuse)
    first = []
    monkeypatch.setattr(sharded, "_loss_of", lambda t, c: first.append(c) or ((0.5,) if c == "mean" else (0.5, 100.0), {"weight": 100.0}))
    sharded.train_epoch(laid, table, 2)
    sharded.train_step(laid, table, 2)
    assert first == ["mean", "g"]
