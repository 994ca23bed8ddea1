"""Slice keys.

Every operator takes `by`, the list of slice columns. Inside an operator the keys
travel as one struct column: a struct is never NULL, so slices with a missing key
join and group like any other, and every shuffle of the operator uses one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

SLICE = "_slice"


def names(keys: str | Sequence[str] | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def slice_key(by: list[str]) -> Column:
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))


def with_slice(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn(SLICE, slice_key(by))


def from_slice(by: list[str]) -> list[Column]:
    return [F.col(SLICE)[b].alias(b) for b in by]


def joinable(stats: DataFrame, by: list[str]) -> DataFrame:
    """Per-slice values ready to join to rows.

    Without slice keys there is exactly one row, which may always be broadcast;
    otherwise the table is written and Spark decides by its size.
    """
    return stage(stats) if by else F.broadcast(stats)


def add_stats(df: DataFrame, by: list[str], stats: DataFrame) -> DataFrame:
    """Put per-slice values next to each row.

    `stats` has one row per slice (column `_slice`). It is written first, so the join below is a broadcast only when the written size
    is under Spark's threshold; otherwise it is a shuffle join in which adaptive
    execution splits a hot slice. A window over the slice would sort a hot slice
    in one task.
    """
    return with_slice(df, by).join(joinable(stats, by), SLICE, "left").drop(SLICE)


def slice_by(df: DataFrame, **keys) -> DataFrame:
    """Rows of one slice; equality on each given key, pushed down to the scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df
