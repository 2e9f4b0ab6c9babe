"""Nothing is cut, dropped or merged in silence."""

import pytest
from pyspark.sql import functions as F

from adloom.operators import factor, linear, metrics, tokens
from adloom.operators.lookup import lookup_join
from adloom.workspace import materialize, release


def test_vectors_of_another_length_fail(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [1.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="components"):
        factor.sum_vectors(rows, "k", "v", 2).collect()


def test_rates_without_a_whole_number_of_parts_fail(spark):
    rows = spark.range(10).withColumnRenamed("id", "instance_id")
    with pytest.raises(ValueError, match="1/n"):
        tokens.sample_instances(rows, 0.4)
    assert tokens.sample_instances(rows, 1.0).count() == 10


def test_lines_with_one_id_stay_apart(spark):
    feats = "array<struct<sign:decimal(20,0),slot:int>>"
    rows = spark.sql(
        f"""SELECT 7L AS instance_id, 1L AS shows, 0L AS clicks, 0 AS label,
        cast(array(named_struct('sign', 1, 'slot', 1), named_struct('sign', 2, 'slot', 1)) AS {feats}) AS feats
        FROM range(3)"""
    )
    keep = spark.sql("SELECT cast(2 AS decimal(20,0)) AS sign")
    got = tokens.filter_instances(rows, keep).collect()
    assert [len(r["feats"]) for r in got] == [1, 1, 1]


def test_rows_without_a_key_stay_spread(spark, no_broadcast):
    left = spark.range(5000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), "id")
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    joined = lookup_join(left, right, "k", "left")
    assert joined.count() == 5000 and joined.where("x = 2 * k").count() == 1667
    parts = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 1000


def test_gradient_has_no_row_without_a_sign(spark):
    t = spark.createDataFrame([(1, 1, 5), (2, 0, None)], "instance_id long, label int, sign long")
    w = spark.createDataFrame([(5, 0.5)], "sign long, w double")
    assert linear.score_linear(t, w).count() == 2
    assert [r["sign"] for r in linear.gradient_linear(t, w).collect()] == [5]


def test_rounded_margins_beyond_the_grid(spark):
    rows = spark.createDataFrame([(i % 2, float(i - 50)) for i in range(100)], "label int, p double")
    assert metrics.auc(rows, 6).first()["auc"] == metrics.auc(rows).first()["auc"]


def test_release_deletes_a_written_table(spark):
    table = materialize(spark.range(5), "gone")
    release(table)
    with pytest.raises(Exception):
        table.count()
