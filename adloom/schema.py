"""Explicit schemas of the frames that cross module boundaries."""

from pyspark.sql import types as T

SIGN_TEXT = T.DecimalType(20, 0)  # an unsigned 64-bit feature sign does not fit BIGINT

FEATURE = T.StructType(
    [T.StructField("sign", SIGN_TEXT), T.StructField("slot", T.IntegerType())]
)

INSTANCES = T.StructType(
    [
        T.StructField("instance_id", T.LongType()),
        T.StructField("shows", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("feats", T.ArrayType(FEATURE)),
    ]
)

FEATURE_STAT = T.StructType(
    [
        T.StructField("sign", SIGN_TEXT),
        T.StructField("show_sum", T.LongType()),
        T.StructField("click_sum", T.LongType()),
    ]
)

FEATURE_FREQ = T.StructType(
    [T.StructField("sign", SIGN_TEXT), T.StructField("freq", T.LongType())]
)

SLOT_STAT = T.StructType(
    [
        T.StructField("freq", T.LongType()),
        T.StructField("sign", SIGN_TEXT),
        T.StructField("slot", T.IntegerType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("iter", T.IntegerType()),
        T.StructField("n_sampled", T.LongType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
    ]
)

STEP_TRACE = T.StructType(
    [
        T.StructField("iter", T.IntegerType()),
        T.StructField("multiplier", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
    ]
)
