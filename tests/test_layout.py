import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.plans import gd, training
from adloom.workspace import shared_dir


@pytest.fixture
def tokens(spark):
    """Instances of one to four tokens; one repeats its sign, one has a token without a sign."""
    rows = [(i, i % 3 % 2, (i * 7 + j * j) % 11) for i in range(300) for j in range(i % 4 + 1)]
    rows += [(300, 1, 5), (300, 1, 5), (301, 0, None), (301, 0, 2)]
    return spark.createDataFrame(rows, "instance_id long, label int, sign long")


def by_sign(weights):
    return {r.sign: r.w for r in weights.collect()}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single|Round)", plan))


@pytest.mark.parametrize("mode", ["aggregated", "per_instance"])
@pytest.mark.parametrize("compat", [False, True])
def test_steps_over_bucketed_tokens_are_the_same(spark, tokens, mode, compat):
    plain, together = training.lay_out(tokens, 0.5), training.lay_out(tokens, 0.5, colocate=True)
    assert together.table and together.sizes == plain.sizes
    old, new = gd.no_weights(tokens), gd.no_weights(tokens)
    for i in range(3):
        a, b = plain.sample(i), together.sample(i)
        assert b.colocated and not a.colocated
        old = gd.gd_step(a.tokens, old, a.n_instances, mode=mode, n_expected=150.0, compat=compat)
        new = gd.gd_step(b.tokens, new, b.n_instances, mode=mode, n_expected=150.0, compat=compat, colocated=True)
        assert by_sign(new) == {k: pytest.approx(v, abs=1e-9) for k, v in by_sign(old).items()}
        old, new = (spark.createDataFrame(w.collect(), w.schema) for w in (old, new))
    plain.release()
    together.release()


@pytest.mark.parametrize("mode", ["aggregated", "per_instance"])
def test_a_bucketed_step_has_one_exchange(spark, tokens, mode):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layout = training.lay_out(tokens, 0.5, colocate=True)
        weights = spark.range(11).select(F.col("id").alias("sign"), F.lit(0.5).alias("w"))
        part = layout.sample(0)
        step = gd.gd_step(part.tokens, weights, part.n_instances, mode=mode, n_expected=150.0, colocated=True)
        assert exchanges(step) == 1
        plain = training.lay_out(tokens, 0.5)
        part = plain.sample(0)
        assert exchanges(gd.gd_step(part.tokens, weights, part.n_instances, mode=mode, n_expected=150.0)) > 2
        layout.release()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_hot_instance_takes_the_layout_that_splits(spark, tokens, monkeypatch):
    monkeypatch.setattr(training, "LEAST_HOT", 5)
    hot = tokens.unionByName(spark.range(500).selectExpr("7L instance_id", "1 label", "id sign"))
    assert training.lay_out(hot, colocate=True).table is None
    empty = training.lay_out(tokens.where("instance_id < 0"), colocate=True)
    assert empty.sizes == {0: 0}
    empty.release()
    one, two = (gd.train_lr_gd(hot, hot, rate=1.0, max_iter=2, colocate=c) for c in (False, True))
    assert by_sign(two.weights) == {k: pytest.approx(v, abs=1e-9) for k, v in by_sign(one.weights).items()}


def test_a_colocated_fit_leaves_its_weights_only(spark, tokens):
    before = set(Path(shared_dir(spark), "adloom").glob("*"))
    fit = gd.train_lr_gd(tokens, tokens, rate=0.5, max_iter=4, colocate=True)
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(shared_dir(spark), "adloom").glob("*")) - before}
    assert left == {"weights-3"} and fit.weights.count() == 11
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("adloom_tokens")]


def test_drawn_samples(spark):
    """Draws repeat with their seed, differ between iterations, and hold the rate on average, 1/n or not."""
    tokens = spark.range(20000).selectExpr("id * 1000003 instance_id", "0 label", "id % 5 sign")
    layout = training.lay_out(tokens, 0.03, draw=4)
    again = training.lay_out(tokens, 0.03, draw=4)
    assert len(layout.sizes) == 334 and sum(layout.sizes.values()) == 20000 and max(layout.sizes.values()) < 120
    parts = [layout.sample(i) for i in range(200)]
    assert np.mean([p.n_instances for p in parts]) == pytest.approx(600, rel=0.05)
    ids = lambda part: {r.instance_id for r in part.tokens.collect()}
    first, period_later = ids(parts[0]), ids(parts[33])
    assert len(first) == parts[0].n_instances and first == ids(again.sample(0)) and first != period_later
    drawn = layout.drawn.of(0)
    read = {int(re.search(r"bucket=(\d+)/", f).group(1)) for f in map(lambda r: r.f, parts[0].tokens.select(F.input_file_name().alias("f")).distinct().collect())}
    assert read == set(drawn)
    plan = parts[0].tokens._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert layout.drawn.of(0) != layout.drawn.of(1)
    with pytest.raises(ValueError):
        training.lay_out(tokens, 1.5, draw=0)


def test_a_fit_over_drawn_samples(spark, tokens, monkeypatch):
    monkeypatch.setattr(training, "FINE_BUCKETS", 10)
    fits = [gd.train_lr_gd(tokens, tokens, rate=0.3, max_iter=3, draw=s, colocate=c) for s, c in ((1, False), (1, True), (2, False))]
    one, same, other = (by_sign(f.weights) for f in fits)
    assert same == {k: pytest.approx(v, abs=1e-9) for k, v in one.items()} and other != one


def test_hot_keys_of_a_draw(spark, monkeypatch):
    monkeypatch.setattr(training, "hot_share", lambda _: 3)
    tokens = spark.range(3000).selectExpr("id instance_id", "0 label", "if(id % 2 = 0, 1, id) sign")
    part = training.lay_out(tokens, 0.2, draw=0).sample(0)
    assert [r.sign for r in part.hot("sign").collect()] == [1]
