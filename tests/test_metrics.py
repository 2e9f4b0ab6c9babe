import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from adloom.operators import metrics
from adloom.operators.ranking import dense_index, range_ordered


def preds(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["label", "p"]), "label int, p double")


def mid_rank_auc(rows):
    pos = np.array([p for y, p in rows if y == 1])
    neg = np.array([p for y, p in rows if y == 0])
    if not len(pos) or not len(neg):
        return None
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, -0.0, 0.1, 0.25, 0.5, 1.0])), min_size=1, max_size=40))
def test_auc_against_all_pairs(spark, rows):
    want = mid_rank_auc(rows)
    for resolution in (None, 6):
        got = metrics.auc(preds(spark, rows), resolution).first().auc
        assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


def skewed_rows():
    """20,000 rows, a third of them on one score."""
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(1, 20, 20000), 4)
    p[::3] = 0.05
    return list(zip((rng.random(20000) < p * 4).astype(int).tolist(), p.tolist()))


def test_auc_equals_ml_evaluator_and_is_monotone_invariant(spark):
    df = preds(spark, skewed_rows())
    library = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    got = metrics.auc(df).first().auc
    assert got == pytest.approx(library.evaluate(df), abs=1e-12)
    assert metrics.auc(df, 6).first().auc == pytest.approx(got, abs=1e-12)
    cubed = df.withColumn("p", F.pow("p", F.lit(3)) * 100 - 7)
    assert metrics.auc(cubed).first().auc == pytest.approx(got, abs=1e-12)


def test_scores_outside_the_unit_interval_still_rank(spark):
    rows = [(0, -3.0), (1, 2.5), (0, 2.0), (1, -4.0)]
    assert metrics.auc(preds(spark, rows), 6).first().auc == mid_rank_auc(rows)


def test_evaluate_edges(spark):
    one_class = metrics.evaluate(preds(spark, [(1, 0.5)])).first()
    assert one_class.auc is None and one_class.n_pos == 1 and one_class.mae == 0.5
    empty = metrics.evaluate(preds(spark, [(1, 0.5)]).where("label = 7"), 6).first()
    assert empty.auc is None and empty.n == 0 and empty.loss == 0.0


def test_wrong_certainty_is_floored(spark):
    loss = metrics.log_loss(preds(spark, [(1, 0.0), (0, 1.0)])).first().loss
    assert loss == pytest.approx(-2 * np.log(1e-10), rel=1e-6)


def test_raw_counts_enter_mae_only(spark):
    got = metrics.evaluate(preds(spark, [(3, 0.5), (1, 0.75), (0, 0.25)])).first()
    assert got.n == 3 and got.n_pos == 1 and got.n_neg == 1
    assert got.mae == pytest.approx((2.5 + 0.25 + 0.25) / 3)
    assert got.loss == pytest.approx(-2 * np.log(0.75))


def test_dense_index_has_no_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 1009).alias("key"))
    got = {r.key: r.idx for r in dense_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 1009


def test_range_parts_ascend(spark):
    df = range_ordered(spark.range(10000).withColumn("key", F.xxhash64("id")), "key", "t")
    parts = df.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
    assert len(parts) > 1
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))
