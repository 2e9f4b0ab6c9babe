"""Readers of the text formats: instance lines, feature lists, statistics, predictions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import binarize_label, strip, to_sign, token_parts
from adloom.operators.ranking import dense_index
from adloom.schema import FEATURE_FREQ, SIGN_TEXT
from adloom.workspace import materialize


# Fixed value: the printed form of a feature's statistics.
_TUPLE = r"^\s*\(\s*(\d+)L?\s*,\s*\(\s*(\d+)L?\s*,\s*(\d+)L?\s*\)\s*\)\s*$"


def _feature_tokens(fields, strict: bool):
    """Feature tokens may stand anywhere in the line, or from the fourth field on."""
    return F.transform(
        token_parts(F.slice(fields, 4, F.size(fields)) if strict else fields),
        lambda p: F.struct(
            to_sign(p[0]).alias("sign"), p[1].try_cast("int").alias("slot")
        ),
    )


def _parsed_lines(spark: SparkSession, path: str, need_slot: bool, strict: bool) -> DataFrame:
    fields = F.split("line", " ")
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"))
    parsed = lines.select(
        "line",
        F.get(fields, 0).alias("line_id"),
        F.get(fields, 0).try_cast("bigint").alias("instance_id"),
        F.get(fields, 1).try_cast("bigint").alias("shows"),
        F.get(fields, 2).try_cast("bigint").alias("clicks"),
        _feature_tokens(fields, strict).alias("feats"),
    )
    bad_token = F.exists(
        "feats",
        lambda f: f["sign"].isNull() | (f["slot"].isNull() if need_slot else F.lit(False)),
    )
    return parsed.withColumn(
        "ok", F.col("shows").isNotNull() & F.col("clicks").isNotNull() & ~bad_token
    )


def read_instances(
    spark: SparkSession,
    path: str,
    label_mode: str = "binary",
    ids: str = "line",
    need_slot: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Instance lines ``lineid shows clicks sign:slot ...`` (plain or gzip, folder or glob).

    ``label_mode`` is ``binary`` (clicked or not) or ``raw`` (the click count itself).
    ``ids`` is ``line`` when the first field is a unique number; ``generated`` numbers
    the lines and writes them once, so that the numbers never change afterwards, and keeps
    the first field as ``line_id``. With ``strict`` features stand from the fourth field on;
    otherwise any field of the right form is one, the first included.
    Malformed lines are left to ``read_rejects``.
    """
    good = _parsed_lines(spark, path, need_slot, strict).where("ok")
    if ids == "line":
        good = good.where(F.col("instance_id").isNotNull())
    else:
        good = good.withColumn("instance_id", F.monotonically_increasing_id())
    label = (
        F.col("clicks").cast("int") if label_mode == "raw" else binarize_label(F.col("clicks"))
    )
    columns = ["instance_id", "shows", "clicks", label.alias("label"), "feats"]
    if ids == "line":
        return good.select(*columns)
    return materialize(good.select(*columns, "line_id"), "instances")


def read_rejects(
    spark: SparkSession, path: str, ids: str = "line", need_slot: bool = False, strict: bool = False
) -> DataFrame:
    """The lines ``read_instances`` leaves out."""
    parsed = _parsed_lines(spark, path, need_slot, strict)
    ok = F.col("ok") & F.col("instance_id").isNotNull() if ids == "line" else F.col("ok")
    return parsed.where(~ok).select("line")


def _complete(parsed: DataFrame) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in parsed.columns if c != "value"])


def _well_formed(parsed: DataFrame) -> DataFrame:
    return parsed.where(_complete(parsed))


def _stat_fields(spark: SparkSession, path: str) -> DataFrame:
    types = {"sign": SIGN_TEXT, "show_sum": "bigint", "click_sum": "bigint"}
    groups = [
        F.regexp_extract("value", _TUPLE, i).try_cast(t).alias(c)
        for i, (c, t) in enumerate(types.items(), start=1)
    ]
    return spark.read.text(path).select("value", *groups)


def _slot_fields(spark: SparkSession, path: str) -> DataFrame:
    fields = F.split(strip(F.col("value")), " ")
    token = F.split(F.get(fields, 1), ":")
    return spark.read.text(path).select(
        "value",
        F.get(fields, 0).try_cast("bigint").alias("freq"),
        to_sign(F.get(token, 0)).alias("sign"),
        F.get(token, 1).try_cast("int").alias("slot"),
    )


def _prediction_fields(spark: SparkSession, path: str, order: str) -> DataFrame:
    types = {"score": ("p", "double"), "label": ("label", "int")}
    named = [types[c.strip()] for c in order.split(",")]
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        "value", *[F.get(fields, i).try_cast(t).alias(c) for i, (c, t) in enumerate(named)]
    )


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """One sign per line, as ``(sign, idx)``."""
    signs = spark.read.text(path).select(to_sign(strip(F.col("value"))).alias("sign"))
    return dense_index(signs, "sign")


def read_feature_freq(spark: SparkSession, path: str, min_freq: int = 10000) -> DataFrame:
    """``sign<TAB>count`` lines with count >= ``min_freq``, as ``(sign, freq, idx)``."""
    freq = (
        spark.read.csv(path, sep="\t", schema=FEATURE_FREQ)
        .where(F.col("freq") >= min_freq)
        .groupBy("sign")
        .agg(F.max("freq").alias("freq"))
    )
    return freq.join(dense_index(freq, "sign"), "sign")


def read_feat_stat_text(spark: SparkSession, path: str) -> DataFrame:
    """Printed tuples ``(sign, (shows, clicks))``; a trailing long marker L is accepted."""
    return _well_formed(_stat_fields(spark, path)).drop("value")


def read_slot_stat(spark: SparkSession, path: str, min_count: int = 500) -> DataFrame:
    """``count sign:slot`` lines with count >= ``min_count``, in any order."""
    return _well_formed(_slot_fields(spark, path)).drop("value").where(F.col("freq") >= min_count)


def read_predictions(spark: SparkSession, path: str, order: str = "score,label") -> DataFrame:
    """Tab-separated predictions; ``order`` names the two columns as they stand."""
    return _well_formed(_prediction_fields(spark, path, order)).select("label", "p")


def read_format_rejects(
    spark: SparkSession, path: str, fmt: str, order: str = "score,label"
) -> DataFrame:
    """The malformed lines of ``feat_stat`` tuples, ``slot_stat`` or ``predictions`` files."""
    if fmt == "predictions":
        parsed = _prediction_fields(spark, path, order)
    else:
        parsed = {"feat_stat": _stat_fields, "slot_stat": _slot_fields}[fmt](spark, path)
    return parsed.where(~_complete(parsed)).select(F.col("value").alias("line"))
