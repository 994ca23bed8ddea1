"""Responses relative to the slice: control maximum, percent inhibition, severity, baseline change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import inhibition, log10_or_null, number, ratio, safe_sqrt, under_policy
from .clean import to_long
from .slices import SLICE, add_stats, names, slice_key

_AGGS = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def window_agg(
    df: DataFrame, by, value: str, fn: str, out: str, null_policy: str = "propagate"
) -> DataFrame:
    """A slice aggregate next to each row, by aggregate and join."""
    by = names(by)
    v = number(value)
    agg = under_policy(_AGGS[fn](v), v, null_policy)
    stats = df.groupBy(slice_key(by).alias(SLICE)).agg(agg.alias(out))
    return add_stats(df, by, stats)


def inhibition_pct(
    df: DataFrame,
    by,
    value: str,
    out: str = "perc_in",
    max_out: str = "max_diam",
    null_policy: str = "propagate",
) -> DataFrame:
    """100 * (max - value) / max with the maximum of the slice `by`; NULL where the maximum is 0."""
    table = window_agg(df, by, value, "max", max_out, null_policy)
    return table.withColumn(out, inhibition(number(value), F.col(max_out)))


def transforms(df: DataFrame, value: str, log_plus: float = 0.0) -> DataFrame:
    """log10 (optionally of value + 1) and square root next to the value; NULL outside their domain."""
    return df.withColumns(
        {"log_diam": log10_or_null(F.col(value), log_plus), "sqrt_diam": safe_sqrt(F.col(value))}
    )


def inhibition_summary(
    df: DataFrame, by, group: str, value: str, max_by=None, null_policy: str = "propagate"
) -> DataFrame:
    """Mean, sd, n and se of percent inhibition per slice and group, in one pass over the rows.

    Percent inhibition is linear in the value once the maximum is known, so the
    rows are reduced to one line per group first; the maximum over `max_by`
    (default: the slice `by`) is then a window over that small table. Neither the
    rows nor a per-row maximum is shuffled.
    """
    by = names(by)
    max_by = by if max_by is None else names(max_by)
    keys = list(dict.fromkeys([*by, *max_by, group]))
    v = number(value)
    fine = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(v).alias("_filled"),
        F.avg(v).alias("_mean"),
        F.var_pop(v).alias("_var"),
        F.max(v).alias("_max"),
    )
    span = Window.partitionBy(*max_by)
    top = F.max("_max").over(span)
    if null_policy == "propagate":
        top = F.when(F.sum("_n").over(span) == F.sum("_filled").over(span), top)
    fine = fine.withColumn("_top", top)
    scale = ratio(F.lit(100.0), F.col("_top"))
    fine = fine.select(
        *by, group, "_n", "_filled",
        inhibition(F.col("_mean"), F.col("_top")).alias("_m"),
        (F.col("_var") * scale * scale).alias("_v"),
    )
    return merge_moments(fine, [*by, group], null_policy)


def merge_moments(fine: DataFrame, keys: list[str], null_policy: str = "propagate") -> DataFrame:
    """Mean, sd, n, se per key from parts (`_n` rows, `_filled` values, `_m` mean, `_v` population variance)."""
    span = Window.partitionBy(*keys)
    weight = F.when(F.col("_m").isNotNull(), F.col("_filled"))
    parts = fine.withColumn("_w", weight).withColumn(
        "_grand", ratio(F.sum(F.col("_w") * F.col("_m")).over(span), F.sum("_w").over(span))
    )
    gap = F.col("_m") - F.col("_grand")
    squares = F.sum(F.col("_w") * (F.col("_v") + gap * gap))
    filled = F.sum(F.coalesce("_w", F.lit(0)))
    whole = F.lit(True) if null_policy == "skip" else (F.sum("_n") == F.sum(F.coalesce("_w", F.lit(0))))
    n = F.sum("_n") if null_policy == "propagate" else filled
    table = parts.groupBy(*keys).agg(
        F.when(whole, F.first("_grand")).alias("mean"),
        F.when(whole & (filled > 1), F.sqrt(ratio(squares, (filled - 1).cast("double")))).alias("sd"),
        n.alias("n"),
    )
    return table.withColumn("se", ratio(F.col("sd"), F.sqrt("n")))


def severity_window(df: DataFrame, by, scale: str, count: str) -> DataFrame:
    """The severity index of the slice next to each rating row; NULL where a scale or count is missing."""
    by = names(by)
    whole = (F.count(scale) == F.count(F.lit(1))) & (F.count(count) == F.count(F.lit(1)))
    stats = df.groupBy(slice_key(by).alias(SLICE)).agg(
        F.max(scale).alias("max_rating"),
        F.when(whole, F.sum(F.col(scale) * F.col(count))).alias("_weighted"),
        F.when(whole, F.sum(count)).alias("_total"),
    )
    table = add_stats(df.withColumn("num_ratings", F.col(scale) * F.col(count)), by, stats)
    index = F.lit(100.0) * ratio(F.col("_weighted"), F.col("_total") * F.col("max_rating"))
    return table.withColumn("dis_sev", index).drop("_weighted", "_total")


def baseline_delta(df: DataFrame, columns: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Baseline minus each of the columns of a wide series (default baseline: the first); row-wise, no shuffle."""
    base = F.col(baseline or columns[0])
    return df.withColumns({c: base - F.col(c) for c in columns})


def series_change(df: DataFrame, ids: Sequence[str], columns: Sequence[str], step: str, value: str) -> DataFrame:
    """Long form of the change from the first column: id, numeric step (1, 2, ...), value."""
    wide = baseline_delta(df.select(*ids, *columns), columns)
    numbered = wide.toDF(*ids, *[str(i + 1) for i in range(len(columns))])
    long = to_long(numbered, ids, step, value)
    return long.withColumn(step, F.col(step).cast("int"))


def baseline_delta_long(df: DataFrame, id, order: str, value: str, out: str = "delta") -> DataFrame:
    """First value of each series (by `order`) minus each value, for a series already in long form."""
    ids = names(id)
    first = df.groupBy(slice_key(ids).alias(SLICE)).agg(F.min_by(value, order).alias("_base"))
    return add_stats(df, ids, first).withColumn(out, F.col("_base") - F.col(value)).drop("_base")
