"""Null-safe arithmetic: masked cells are NULL, and nothing raises or leaves NaN behind by accident."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_invalid(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def floordiv(a: Column, b: Column) -> Column:
    """Floors towards minus infinity; NULL for a zero divisor."""
    return F.floor(div(a, b)).cast("double")


def mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; NULL for a zero divisor."""
    return a - floordiv(a, b) * b


def power(a: Column, b: Column) -> Column:
    return masked_invalid(F.pow(a, b))


def log(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def isclose(a: Column, b: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * abs(b)


def bias180(c: Column) -> Column:
    """A difference of directions brought to -180..180."""
    return F.when(c > 180, c - 360).when(c < -180, c + 360).otherwise(c)
