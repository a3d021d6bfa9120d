"""Numeric Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row.

    Inside a higher-order function an outer expression is evaluated again for every element;
    binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def round_to(x: Column, digits: int) -> Column:
    """Round half up on the binary value; the same rule in Spark and in plain SQL."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fixed_text(x: Column, digits: int) -> Column:
    """`x` with `digits` decimals (8 at most) as C's printf writes it, null for null: the double's exact
    value decides, an exact tie goes to the even digit. format_string goes by the shortest decimal that
    reads back as the double, half up, so it writes 0.51345 (in truth a little less) as 0.5135.

    The double is split into two parts whose products with the scale are exact; values from
    2^53 / 10^digits on are left to format_string.
    """
    scale, size = 10**digits, F.abs(x)
    upper = size.cast("float").cast("double")
    a, b = upper * F.lit(float(scale)), (size - upper) * F.lit(float(scale))
    below, near = F.floor(a), F.rint(b)
    whole, over = below + near.cast("long"), (a - below - F.lit(0.5)) + (b - near)
    odd = whole % 2 == 1
    units = whole + F.when((over > 0) | ((over == 0) & odd), 1).when((over == -1) & odd, -1).otherwise(0)
    rest = units % scale
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(
        sign, ((units - rest) / scale).cast("long").cast("string"),
        *([F.lit("."), F.lpad(rest.cast("string"), digits, "0")] if digits else []),
    )
    return F.when(size < F.lit(2.0**53 / scale), text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """numerator / denominator, or `otherwise` where the denominator is not positive."""
    return F.when(denominator > 0, dbl(numerator) / dbl(denominator)).otherwise(F.lit(otherwise))


def piecewise_linear(
    x: Column, points: Sequence[tuple[float, float]], digits: int | None = None
) -> Column:
    """Linear interpolation through `points` (ascending x), flat outside the first and last."""
    out = F.when(x <= F.lit(points[0][0]), F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        step = F.lit(y0) + ((x - F.lit(x0)) / F.lit(x1 - x0)) * F.lit(y1 - y0)
        out = out.when(x <= F.lit(x1), step)
    out = out.otherwise(F.lit(points[-1][1]))
    return round_to(out, digits) if digits is not None else out


def band(x: Column, bands: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """The label of the highest lower bound that `x` reaches."""
    out = None
    for low, label in sorted(bands, reverse=True):
        hit = x >= F.lit(low)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise).cast("string"))
