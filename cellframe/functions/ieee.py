"""Column functions with IEEE results where SQL raises an error or returns null.

All take and return double columns; truth is 1.0 and 0.0, and NaN is a value, not a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def number(value: float) -> Column:
    return F.lit(float(value))


def truth(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def is_true(x: Column) -> Column:
    """Nonzero and not NaN."""
    return (x != 0) & ~F.isnan(x)


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN instead of an error; a divisor of zero counts as positive."""
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; NaN for a divisor of zero."""
    return F.when(b == 0, nan()).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def _ordered(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def compare(op: str, a: Column, b: Column) -> Column:
    """1.0 if the comparison holds; false, != included, as soon as a side is NaN."""
    holds = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return truth(_ordered(a, b) & holds)


def lesser(a: Column, b: Column) -> Column:
    return F.when(_ordered(a, b), F.least(a, b)).otherwise(nan())


def greater(a: Column, b: Column) -> Column:
    return F.when(_ordered(a, b), F.greatest(a, b)).otherwise(nan())


def logarithm(x: Column, base: float | None = None) -> Column:
    safe = F.when(x > 0, x).otherwise(1.0)
    found = F.log10(safe) if base == 10 else F.log(safe)
    return F.when(F.isnan(x) | (x < 0), nan()).when(x == 0, -inf()).otherwise(found)


def _whole(x: Column, f) -> Column:
    """Rounding keeps what has no fraction anyway, beyond 2^53, infinite or NaN."""
    return F.when(F.isnan(x) | (F.abs(x) >= float(2**53)), x).otherwise(f(F.when(F.isnan(x) | (F.abs(x) >= float(2**53)), 0.0).otherwise(x)).cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def round_half_away(x: Column) -> Column:
    return _whole(x, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5))


def nearest_image(x: Column) -> Column:
    """floor(x + 1/2), the rounding of image numbers."""
    return F.floor(x + 0.5).cast("double")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))
