"""Group summaries and rates. Each is one aggregation with map-side partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number, ratio, under_policy
from .clean import flag_threshold
from .slices import names


def treatment_summary(df: DataFrame, by, group, value: str, null_policy: str = "propagate") -> DataFrame:
    """mean, sample sd, n and se = sd / sqrt(n) per slice and group."""
    v = number(value)
    n = F.count(F.lit(1)) if null_policy == "propagate" else F.count(v)
    table = df.groupBy(*names(by), *names(group)).agg(
        under_policy(F.avg(v), v, null_policy).alias("mean"),
        under_policy(F.stddev_samp(v), v, null_policy).alias("sd"),
        n.alias("n"),
    )
    return table.withColumn("se", ratio(F.col("sd"), F.sqrt("n")))


def sliced_and_pooled(df: DataFrame, keys, pool: str, group: str, value: str) -> DataFrame:
    """The summary per (keys, pool, group) and over `pool`, from one scan.

    Rows are reduced to cells once. The grouping sets then run on the cells, and
    the pooled variance is put together from cell variances and cell means.
    `pooled` is 1 on the pooled rows, where `pool` is NULL.
    """
    keys = names(keys)
    v = number(value)
    cells = df.groupBy(*keys, pool, group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(v).alias("_filled"),
        F.avg(v).alias("_m"),
        F.var_pop(v).alias("_v"),
    )
    span = Window.partitionBy(*keys, group)
    cells = cells.withColumn(
        "_grand", ratio(F.sum(F.col("_filled") * F.col("_m")).over(span), F.sum("_filled").over(span))
    )
    is_pooled = F.grouping(pool) == 1
    gap = F.col("_m") - F.col("_grand")
    within = F.sum(F.col("_filled") * F.col("_v"))
    squares = F.when(is_pooled, within + F.sum(F.col("_filled") * gap * gap)).otherwise(within)
    whole = F.sum("_n") == F.sum("_filled")
    n = F.sum("_n")
    fine, wide = [*keys, pool, group], [*keys, group]
    table = cells.groupingSets([fine, wide], *fine).agg(
        F.grouping(pool).cast("int").alias("pooled"),
        F.when(whole, F.when(is_pooled, F.first("_grand")).otherwise(F.first("_m"))).alias("mean"),
        F.when(whole & (n > 1), F.sqrt(ratio(squares, (n - 1).cast("double")))).alias("sd"),
        n.alias("n"),
    )
    return table.withColumn("se", ratio(F.col("sd"), F.sqrt("n")))


def germination_rate(df: DataFrame, by, value: str, offset: float = 0.0, se_offset: float = 0.0) -> DataFrame:
    """100 * sum / n + offset per slice, with mean, sd, n and se = sd / sqrt(n) + se_offset."""
    v = number(value)
    table = df.groupBy(*names(by)).agg(
        under_policy(F.avg(v), v, "propagate").alias("mean"),
        under_policy(F.stddev_samp(v), v, "propagate").alias("sd"),
        F.count(F.lit(1)).alias("n"),
        under_policy(F.sum(v), v, "propagate").alias("_sum"),
    )
    return table.select(
        *names(by), "mean", "sd", "n",
        (ratio(F.col("sd"), F.sqrt("n")) + F.lit(float(se_offset))).alias("se"),
        (ratio(F.lit(100.0) * F.col("_sum"), F.col("n").cast("double")) + F.lit(float(offset))).alias("rate"),
    )


def incidence_pct(df: DataFrame, by, value: str, cut: float) -> DataFrame:
    """Percent of rows at or above the cut, per slice."""
    flagged = flag_threshold(df, value, cut, "_flag")
    positives = under_policy(F.sum("_flag"), F.col("_flag"), "propagate")
    return flagged.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.lit(100.0) * positives, F.count(F.lit(1)).cast("double")).alias("incidence"),
    )


def severity_index(
    df: DataFrame, by, scale: str, count: str, max_scale: float | None = None
) -> DataFrame:
    """100 * sum(scale * count) / (sum(count) * max(scale)) per slice; the maximum is the slice's own by default."""
    top = F.max(scale) if max_scale is None else F.lit(max_scale)
    s, c = F.col(scale), F.col(count)
    whole = (F.count(s) == F.count(F.lit(1))) & (F.count(c) == F.count(F.lit(1)))
    table = df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        top.alias("max_rating"),
        F.when(whole, F.sum(s * c)).alias("_weighted"),
        F.when(whole, F.sum(c)).alias("_total"),
    )
    index = F.lit(100.0) * ratio(F.col("_weighted"), F.col("_total") * F.col("max_rating"))
    return table.withColumn("dis_sev", index).drop("_weighted", "_total")


def summary_stats(df: DataFrame, by, value: str) -> DataFrame:
    """n of present values, mean and sd per slice; not rounded."""
    v = number(value)
    return df.groupBy(*names(by)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def mean_se(df: DataFrame, by, x: str, fill: str | None, value: str) -> DataFrame:
    """Mean with one standard error each way, per bar; missing values are left out."""
    keys = list(dict.fromkeys([x, *names(fill)]))
    table = treatment_summary(df, by, keys, value, null_policy="skip")
    return table.withColumns({"ymin": F.col("mean") - F.col("se"), "ymax": F.col("mean") + F.col("se")})
