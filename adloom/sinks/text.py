"""Writers of the text formats. Each one is a projection and a distributed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.columns import fixed, fixed6

_TAB = "\t"


def _sign() -> Column:
    return F.col("sign").cast("string")


def _write(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def iteration_path(path: str, iteration: int) -> str:
    return f"{path.rstrip('/')}/iter={iteration}"


def instance_line(id_column: str = "instance_id") -> Column:
    tokens = F.transform(
        "feats", lambda f: F.concat_ws(":", f["sign"].cast("string"), f["slot"].cast("string"))
    )
    return F.concat_ws(
        " ",
        F.col(id_column).cast("string"),
        F.col("shows").cast("string"),
        F.col("clicks").cast("string"),
        F.array_join(tokens, " "),
    )


def feat_stat_line() -> Column:
    return F.concat(
        F.lit("("), _sign(), F.lit(", ("), F.col("show_sum").cast("string"),
        F.lit(", "), F.col("click_sum").cast("string"), F.lit("))"),
    )


def weight_line() -> Column:
    return F.concat_ws(_TAB, _sign(), fixed6(F.col("w")))


def gradient_line() -> Column:
    return F.concat_ws(_TAB, _sign(), fixed6(F.col("g")))


def prediction_line() -> Column:
    return F.concat_ws(_TAB, fixed6(F.col("p")), F.col("label").cast("string"))


def fm_weight_line() -> Column:
    """Factors keep 12 digits; the weight has the 6 of the linear format."""
    factors = F.transform("v", lambda x: fixed(x, 12))
    line = F.concat_ws(_TAB, _sign(), fixed6(F.col("w")))
    return F.when(F.size("v") > 0, F.concat_ws(_TAB, line, F.array_join(factors, _TAB))).otherwise(
        F.concat(line, F.lit(_TAB))
    )


def write_feat_stat(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``(sign, show_sum, click_sum)`` as Parquet, or as printed tuples with ``text``."""
    if fmt == "text":
        _write(df, feat_stat_line(), path)
    else:
        df.write.parquet(path)


def write_feature_list(df: DataFrame, path: str) -> None:
    _write(df, _sign(), path)


def write_instances(df: DataFrame, path: str) -> None:
    """A ``line_id``, where there is one, stands first instead of the number."""
    _write(df, instance_line("line_id" if "line_id" in df.columns else "instance_id"), path)


def write_feat_freq(df: DataFrame, path: str) -> None:
    df.select("sign", "freq").write.option("sep", _TAB).csv(path)


def write_weights(df: DataFrame, path: str, iteration: int) -> None:
    """Non-zero weights only."""
    _write(df.where(F.col("w") != 0), weight_line(), iteration_path(path, iteration))


def write_gradient(df: DataFrame, path: str, iteration: int) -> None:
    _write(df, gradient_line(), iteration_path(path, iteration))


def write_predictions(df: DataFrame, path: str, iteration: int) -> None:
    _write(df, prediction_line(), iteration_path(path, iteration))


def write_fm_weights(df: DataFrame, path: str, iteration: int) -> None:
    _write(df, fm_weight_line(), iteration_path(path, iteration))
