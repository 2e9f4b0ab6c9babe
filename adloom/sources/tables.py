"""Instances and tokens taken from plain tables instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import binarize_label
from adloom.operators.lookup import lookup_join

SLOT_WIDTH = 1000000  # a table feature's sign is slot * SLOT_WIDTH + value


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_sign(slot: int, value: Column) -> Column:
    return F.lit(slot * SLOT_WIDTH).cast("bigint") + value.cast("bigint")


def instances_from_table(
    df: DataFrame, instance_id: str, shows: Column, clicks: Column, slots: dict[int, Column]
) -> DataFrame:
    """One instance per row of ``df``; each slot's column becomes one feature.

    A missing value gives no feature. ``instance_id`` must be unique.
    """
    feats = F.array(
        *[
            F.struct(slot_sign(slot, value).alias("sign"), F.lit(slot).alias("slot"))
            for slot, value in slots.items()
        ]
    )
    return df.select(
        F.col(instance_id).alias("instance_id"),
        shows.cast("bigint").alias("shows"),
        clicks.cast("bigint").alias("clicks"),
        binarize_label(clicks).alias("label"),
        F.filter(feats, lambda f: f["sign"].isNotNull()).alias("feats"),
    )


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event shown once; a click event is a click."""
    return instances_from_table(
        read_table(spark, sf_dir, "events"),
        "event_id",
        F.lit(1),
        F.when(F.col("event_type") == "click", 1).otherwise(0),
        {
            1: F.col("user_id"),
            2: F.hour("ts"),
            3: F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint"),
            4: F.floor(F.col("value") / 10),
        },
    )


def order_tokens(spark: SparkSession, sf_dir: str, label_mode: str = "binary") -> DataFrame:
    """Orders as instances, two tokens per line item; an order may hold any share of lines.

    Shows are the order's lines and clicks its returned lines, so labels above 1 and
    repeated tokens occur. The order is never gathered into one row.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"),
        "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        "l_returnflag",
    )
    totals = lines.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("shows"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("clicks"),
    )
    label = (
        F.col("clicks").cast("int") if label_mode == "raw" else binarize_label(F.col("clicks"))
    )
    headers = totals.withColumn("label", label)
    n = lines.count()
    # Two tokens come of a line: partitions that suit them need no other shuffle on the order.
    labelled = lookup_join(lines, headers, "instance_id", "inner", right_rows=n, rows=2 * n)
    feats = F.array(
        F.struct(slot_sign(1, F.col("l_suppkey")).alias("sign"), F.lit(1).alias("slot")),
        F.struct(slot_sign(2, F.col("quantity")).alias("sign"), F.lit(2).alias("slot")),
    )
    return (
        labelled.select("instance_id", "shows", "clicks", "label", F.explode(feats).alias("f"))
        .select("instance_id", "shows", "clicks", "label", "f.sign", "f.slot")
        .where(F.col("sign").isNotNull())
    )


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blank-separated word of every document, once per document."""
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("instance_id"),
        F.explode(F.array_distinct(F.split("text", " "))).alias("word"),
    )
