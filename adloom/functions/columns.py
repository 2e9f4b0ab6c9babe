"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.schema import SIGN_TEXT

# Beyond these margins the score is taken as exactly 0 or 1.
LR_BOUND = 30.0
FM_BOUND = 500.0
# Fixed value: probability floor inside the logarithm of the log loss.
LOSS_FLOOR = 1e-10

# A prime above the usual id strides and a multiplier coprime to it.
_MIX_PRIME = 1000003
_MIX_FACTOR = 48271


def sigmoid_clamped(z: Column, bound: float) -> Column:
    return (
        F.when(z >= bound, 1.0)
        .when(z <= -bound, 0.0)
        .otherwise(1.0 / (1.0 + F.exp(-z)))
    )


def binarize_label(clicks: Column) -> Column:
    return F.when(clicks > 0, 1).otherwise(0)


def log_loss_term(label: Column, p: Column, floor: float = LOSS_FLOOR) -> Column:
    """Negative log likelihood of one row; labels other than 0 and 1 add nothing."""
    return (
        F.when(label == 1, -F.ln(F.greatest(p, F.lit(floor))))
        .when(label == 0, -F.ln(F.greatest(1.0 - p, F.lit(floor))))
        .otherwise(0.0)
    )


def sample_bucket(instance_id: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal parts an instance belongs to; even over any id pattern."""
    mixed = F.pmod(
        F.pmod(instance_id, F.lit(_MIX_PRIME)) * F.lit(_MIX_FACTOR), F.lit(_MIX_PRIME)
    )
    return F.pmod(mixed, F.lit(buckets)).cast("int")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def token_parts(fields: Column) -> Column:
    """The fields that split on ':' into exactly two parts, as those parts."""
    parts = F.transform(fields, lambda t: F.split(t, ":"))
    return F.filter(parts, lambda p: F.size(p) == 2)


def to_sign(text: Column) -> Column:
    """Whole numbers only; a plain decimal cast would round '12.5' into a sign.

    Only signs beyond BIGINT, and broken ones, reach the slower second branch.
    """
    return F.coalesce(
        text.try_cast("bigint").cast(SIGN_TEXT),
        F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(SIGN_TEXT)),
    )


def fixed(value: Column, digits: int) -> Column:
    """``value`` with so many decimals, rounded as stored: by all its binary digits, halves to even.

    Spark's own format rounds the shortest decimal that names a value. That may end in a five
    where the value itself lies beside the half. Here the product with the power of ten is taken
    apart into a rounded one and its error, without loss. What fills more than 62 bits, null and
    non-finite values keep Spark's format.
    """
    split, scale = float(2**27 + 1), 10.0**digits
    sh = split * scale - (split * scale - scale)
    sl = scale - sh
    x = F.abs(value)
    xh = x * split - (x * split - x)
    xl = x - xh
    product = x * scale
    error = xl * sl - (((product - xh * sh) - xl * sh) - xh * sl)
    carried = F.when(product >= 2.0**52, F.floor(error)).otherwise(F.lit(0).cast("bigint"))
    down = F.floor(product) + carried
    beyond = (product - F.floor(product) - 0.5) + (error - carried)  # its sign is exact
    up = (beyond > 0) | ((beyond == 0) & (down % 2 == 1))
    text = (down + F.when(up, 1).otherwise(0)).cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(digits + 1)), F.lit("0"))
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, F.regexp_replace(padded, f"([0-9]{{{digits}}})$", ".$1"))
    return F.when(product < 2.0**62, exact).otherwise(F.format_string(f"%.{digits}f", value))


def fixed6(value: Column) -> Column:
    return fixed(value, 6)


def factor(v: Column, k: int) -> Column:
    """Component ``k`` of a factor vector; an empty or missing vector counts as zeros."""
    return F.coalesce(F.get(v, F.lit(k)), F.lit(0.0))
