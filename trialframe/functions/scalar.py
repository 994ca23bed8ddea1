"""Scalar Column functions and the missing-value policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: Column | str) -> Column:
    """The column as a double in which NaN counts as missing."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(top, bottom)


def log10_or_null(col: Column, plus: float = 0.0) -> Column:
    """log10(x + plus); NULL where the argument is not positive."""
    return F.log10(col + F.lit(plus)) if plus else F.log10(col)


def safe_sqrt(col: Column) -> Column:
    """Square root; NULL for negative input."""
    return F.when(col >= 0, F.sqrt(col))


def inhibition(value: Column, maximum: Column) -> Column:
    """Percent reduction relative to the slice maximum."""
    return ratio(F.lit(100.0) * (maximum - value), maximum)


def under_policy(agg: Column, value: Column, policy: str) -> Column:
    """`propagate`: one missing value makes the aggregate missing. `skip`: missing values are ignored."""
    if policy == "skip":
        return agg
    if policy == "propagate":
        return F.when(F.count(value) == F.count(F.lit(1)), agg)
    raise ValueError(f"unknown null policy {policy!r}")


def star_code(p: Column) -> Column:
    """Significance stars of a p-value."""
    return (
        F.when(p <= 1e-4, "****")
        .when(p <= 1e-3, "***")
        .when(p <= 0.01, "**")
        .when(p <= 0.05, "*")
        .when(p.isNotNull(), "ns")
    )
