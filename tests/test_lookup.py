from collections import Counter

import pytest
from pyspark.sql import functions as F

from adloom.operators import lookup
from adloom.operators.lookup import fits_broadcast, hot_keys, lookup_join
from adloom.plans.vector_free import training_part


def skewed(spark, n=9000):
    """A third of the rows share key 7, one in nine has no key, the rest are spread."""
    key = (
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 9 == 1, None)
        .otherwise(F.col("id") % 2000)
    )
    return spark.range(n).select(F.col("id"), key.cast("bigint").alias("key"))


def table(spark, with_hot=True):
    t = spark.range(0, 1500).select(F.col("id").alias("key"), (F.col("id") * 2.5).alias("w"))
    return t if with_hot else t.where("key <> 7")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("with_hot", [True, False])
def test_shuffled_path_equals_plain_join(spark, no_broadcast, how, with_hot):
    left, right = skewed(spark), table(spark, with_hot)
    got = lookup_join(left, right, "key", how)
    want = left.join(right, "key", how)
    assert Counter(got.select(*want.columns).collect()) == Counter(want.collect())


def test_hot_rows_are_not_shuffled(spark, no_broadcast):
    left, right = skewed(spark), table(spark)
    plan = lookup_join(left, right, "key")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_hot_keys_are_few(spark):
    assert [r.key for r in hot_keys(skewed(spark), "key").collect()] == [7]
    assert hot_keys(spark.range(5000).withColumnRenamed("id", "key"), "key").count() == 0


def test_size_is_measured(spark):
    words = spark.createDataFrame([("a" * 100,)] * 50, "word string")
    spark.conf.set("spark.adloom.broadcastBytes", "5000")
    try:
        assert not lookup.fits_broadcast(words)
        assert lookup.fits_broadcast(words.limit(5))
        assert not lookup.fits_broadcast(spark.range(1), rows=1000)
    finally:
        spark.conf.unset("spark.adloom.broadcastBytes")


@pytest.mark.parametrize(
    "name", ["gradient_linear", "gd_step_per_instance", "filter_instances", "fm_gradient", "encode_slots"]
)
def test_queries_agree_without_broadcast(spark, small, no_broadcast, name):
    import check
    from __spark_entry__ import oracle_sql, queries

    con = check.connect(small)
    assert check.difference(queries()[name](spark, small), con, oracle_sql()[name]) is None


def test_residuals_of_many_instances_stay_off_the_driver(spark):
    residuals = spark.range(600_000).select(F.col("id").alias("instance_id"), F.lit(0.5).alias("r"))
    assert not fits_broadcast(residuals, 600_000)
    tokens = spark.range(40).select((F.col("id") % 20).alias("instance_id"), F.lit(1).alias("label"), F.col("id").alias("sign"))
    part = training_part(tokens, tokens)
    assert part.colocated
    part.release()


def test_shuffled_lookups_take_partitions_by_their_rows(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(lookup, "PART_ROWS", 100)
    left = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    joined = lookup.lookup_join(left, right, "k", "inner")
    assert joined.where("x = 2 * k").count() == 5000
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 250
