"""Distribution checks: outliers, description, normality, shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import add_normal_quantile, normal_sf
from ..functions.scalar import number, ratio
from ..sources.staging import stage
from .linear import residuals
from .ordering import (
    BELOW,
    COUNT,
    TOTAL,
    VALUE,
    at_position,
    join_stats,
    quantile_aggs,
    ranked,
    slice_quantiles,
    sorted_counts,
    value_counts,
)
from .slices import SLICE, add_stats, from_slice, names, slice_key


def identify_outliers(df: DataFrame, by, value: str) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges from the quartiles; `is_extreme` beyond 3."""
    by = names(by)
    fences = slice_quantiles(sorted_counts(value_counts(df, by, value)), {"_q1": 0.25, "_q3": 0.75})
    v, q1, q3 = number(value), F.col("_q1"), F.col("_q3")
    spread = q3 - q1

    def beyond(k: float) -> Column:
        return (v < q1 - F.lit(k) * spread) | (v > q3 + F.lit(k) * spread)

    table = add_stats(df, by, fences).withColumns({"is_outlier": beyond(1.5), "is_extreme": beyond(3.0)})
    return table.filter("is_outlier").drop("_q1", "_q3")


def type2_shape(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from the population forms."""
    n = n.cast("double")
    g1 = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.when(n != 2, n - 2))
    g2 = F.when(n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
    return g1, g2


def shape_stats(df: DataFrame, by, value: str) -> DataFrame:
    """Type-2 skewness and kurtosis per slice; NULL for constant or too small slices."""
    by = names(by)
    v = number(value)
    table = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2")
    )
    skew, kurt = type2_shape(F.col("n"), F.col("_g1"), F.col("_g2"))
    return table.select(*by, "n", skew.alias("skew"), kurt.alias("kurtosis"))


def describe(df: DataFrame, by, value: str, trim: float = 0.1) -> DataFrame:
    """n, mean, sd, median, trimmed mean, MAD (x 1.4826), min, max, range, skew, kurtosis, se per slice.

    The rows are read once, into value counts. Median, trimmed mean and mean come
    from the ranked counts; the higher moments are sums of powers of the distance
    from the mean, and the MAD ranks the distances from the median.
    """
    by = names(by)
    counts = sorted_counts(value_counts(df, by, value))
    cut = F.floor(F.col(TOTAL) * F.lit(trim))
    kept = F.greatest(
        F.lit(0),
        F.least(F.col(BELOW) + F.col(COUNT), F.col(TOTAL) - cut) - F.greatest(F.col(BELOW), cut),
    ).cast("double")
    weight = F.col(COUNT).cast("double")
    centre = stage(
        ranked(counts)
        .groupBy(SLICE)
        .agg(
            *quantile_aggs({"median": 0.5}),
            ratio(F.sum(kept * F.col(VALUE)), F.sum(kept)).alias("trimmed"),
            F.sum(COUNT).alias("n"),
            (F.sum(weight * F.col(VALUE)) / F.sum(weight)).alias("mean"),
            F.min(VALUE).alias("min"),
            F.max(VALUE).alias("max"),
        )
    )
    centred = join_stats(counts, centre.select(SLICE, "median", "mean"))
    gap = F.col(VALUE) - F.col("mean")
    powers = centred.groupBy(SLICE).agg(
        *[F.sum(weight * F.pow(gap, F.lit(k))).alias(f"_s{k}") for k in (2, 3, 4)]
    )
    distances = (
        centred.select(SLICE, F.abs(F.col(VALUE) - F.col("median")).alias(VALUE), COUNT)
        .groupBy(SLICE, VALUE)
        .agg(F.sum(COUNT).alias(COUNT))
    )
    mad = slice_quantiles(sorted_counts(distances), {"_mad": 0.5})
    table = centre.join(powers, SLICE).join(mad, SLICE)
    # rounding can leave dust where every value equals the mean
    spread = F.when(F.col("max") > F.col("min"), F.col("_s2") / F.col("n"))
    table = table.withColumn("_var", spread).withColumn(
        "sd",
        F.when(F.col("n") > 1, F.sqrt(F.coalesce(F.col("_var"), F.lit(0.0)) * F.col("n") / (F.col("n") - 1))),
    )
    variance, n = F.col("_var"), F.col("n")
    skew, kurt = type2_shape(
        n, F.col("_s3") / n / (variance * F.sqrt(variance)), F.col("_s4") / n / (variance * variance) - 3
    )
    return table.select(
        *from_slice(by), "n", "mean", "sd", "median", "trimmed",
        (F.col("_mad") * F.lit(1.4826)).alias("mad"),
        "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
        skew.alias("skew"),
        kurt.alias("kurtosis"),
        ratio(F.col("sd"), F.sqrt("n")).alias("se"),
    )


# Polynomial constants of the normality test (P. Royston, Applied
# Statistics 44, 1995), lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_SHIFT = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
#: p is calibrated up to HIGHEST_N values.
LOWEST_N, HIGHEST_N = 3, 5000
#: Places at either end of a slice whose normal scores are summed one by one.
ENDS = 64


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _with_score(df: DataFrame, i: Column, n: Column, out: str) -> DataFrame:
    """Add the approximate expected value of the i-th of n normal order statistics."""
    position = (i - F.lit(0.375)) / (n + F.lit(0.25))
    return add_normal_quantile(df.withColumn("_place", position), "_place", out).drop("_place")


def _density(z: str) -> Column:
    return F.exp(-F.col(z) * F.col(z) / 2) / math.sqrt(2 * math.pi)


def _run_sum(z1: str, z2: str, n: Column) -> Column:
    """Sum of the normal scores of a run of places, from the scores half a place before it and after it.

    The integral of the quantile is minus the density; the Euler-Maclaurin terms of the midpoint rule follow, with the derivatives of the
    quantile. The first and last `ENDS` places are left to direct sums, so what is cut off is below 1e-12.
    """
    width = n + F.lit(0.25)

    def terms(name: str) -> Column:
        z, h = F.col(name), F.lit(1.0) / (width * _density(name))
        fifth = (7 + 46 * z * z + 24 * z * z * z * z) * F.pow(h, F.lit(5))
        return -width * _density(name) - h / 24 + (1 + 2 * z * z) * F.pow(h, F.lit(3)) * (7 / 5760) - fifth * (31 / 967680)

    return terms(z2) - terms(z1)


def _squares_sum(z1: str, n: Column) -> Column:
    """Sum of the squared scores of the places between the ends, which lie evenly about the middle; `z1` as above."""
    z, width = F.col(z1), n + F.lit(0.25)
    share, h = (F.lit(ENDS + 0.125)) / width, F.lit(1.0) / (width * _density(z1))
    inner = width * (1 - 2 * share + 2 * z * _density(z1))
    third = (8 * z + 4 * z * z * z) * F.pow(h, F.lit(3))
    fifth = z * (104 + 192 * z * z + 48 * z * z * z * z) * F.pow(h, F.lit(5))
    return inner + 2 * (2 * z * h / 24 - third * (7 / 5760) + fifth * (31 / 967680))


def _score_products(table: DataFrame) -> DataFrame:
    """(slice): sum of score times distance from the mean over all rows, from ranked value counts; tied rows are not laid out.

    A value's run of places has a sum of scores of its own; only the first and last `ENDS` places of a slice are taken singly.
    """
    n, gap = F.col(TOTAL), F.col(VALUE) - F.col("_mean")
    first, last = F.col(BELOW) + 1, F.col(BELOW) + F.col(COUNT)
    runs = table.select(
        SLICE, gap.alias("_gap"), n.alias("_n"), F.greatest(first, F.lit(ENDS + 1)).alias("_a"), F.least(last, n - ENDS).alias("_b"), first.alias("_first"), last.alias("_last")
    )
    half = F.when(F.col("_a") == F.col("_b"), 0.0).otherwise(0.5)  # a single place has its own score
    middle = runs.filter("_a <= _b").withColumns({"_lo": F.col("_a") - half, "_hi": F.col("_b") + half})
    middle = _with_score(_with_score(middle, F.col("_lo"), F.col("_n"), "_z1"), F.col("_hi"), F.col("_n"), "_z2")
    total = F.when(F.col("_a") == F.col("_b"), F.col("_z1")).otherwise(_run_sum("_z1", "_z2", F.col("_n")))
    parts = middle.select(SLICE, (total * F.col("_gap")).alias("_mx"))
    low = F.when(F.col("_first") <= ENDS, F.sequence("_first", F.least(F.col("_last"), F.lit(ENDS).cast("long"))))
    high_start = F.greatest(F.col("_first"), F.greatest(F.col("_n") - ENDS, F.lit(ENDS)) + 1)
    high = F.when(high_start <= F.col("_last"), F.sequence(high_start, F.col("_last")))
    none = F.array().cast("array<bigint>")
    single = runs.select(SLICE, "_gap", "_n", F.explode(F.concat(F.coalesce(low, none), F.coalesce(high, none))).alias("_i"))
    single = _with_score(single, F.col("_i"), F.col("_n"), "_m")
    parts = parts.unionByName(single.select(SLICE, (F.col("_m") * F.col("_gap")).alias("_mx")))
    return parts.groupBy(SLICE).agg(F.sum("_mx").alias("_mx"))


def _score_squares(sizes: DataFrame) -> DataFrame:
    """(slice): sum of the squared scores of n places (`_size`), from at most `ENDS` single places and the run between."""
    n = F.col("_size").cast("long")
    ends = sizes.select(SLICE, "_size", F.explode(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(ENDS).cast("long")))).alias("_i"))
    ends = _with_score(ends, F.col("_i"), F.col("_size"), "_m")
    # of a small slice the upper half is the lower half mirrored
    twice = F.when(2 * F.col("_i") <= F.col("_size"), 2.0).when(2 * F.col("_i") == F.col("_size") + 1, 1.0).otherwise(0.0)
    whole = F.when(F.col("_size") > 2 * ENDS, 2.0).otherwise(twice)
    ends = ends.groupBy(SLICE).agg(F.sum(whole * F.col("_m") * F.col("_m")).alias("_ends"), F.first("_size").alias("_size"))
    table = _with_score(ends, F.lit(ENDS + 0.5), F.greatest(F.col("_size"), F.lit(2.0 * ENDS)), "_z1")
    between = F.when(F.col("_size") > 2 * ENDS, _squares_sum("_z1", F.col("_size"))).otherwise(F.lit(0.0))
    return table.select(SLICE, (F.col("_ends") + between).alias("_ss"))


def shapiro(df: DataFrame, by, value: str) -> DataFrame:
    """Shapiro-Wilk W and p per slice, for 3 or more present values.

    W is computed for every size. p is calibrated up to 5000 values: above that it is an extrapolation, and the
    reason says so. Other slices have a reason and no W. Places come from the ranked value counts, so no
    slice is sorted in one task, and a value tied any number of times is one run of places. Normal scores are symmetric,
    so W needs only sums over the slice and its two lowest and two highest values.
    """
    by = names(by)
    rows = df.select(slice_key(by).alias(SLICE), number(value).alias(VALUE))
    sizes = stage(
        rows.groupBy(SLICE).agg(
            F.count(VALUE).alias("n"), F.min(VALUE).alias("_lo"), F.max(VALUE).alias("_hi"), F.avg(VALUE).alias("_mean")
        )
    )
    flat = F.col("_lo") == F.col("_hi")
    reason = (
        F.when(F.col("n") < LOWEST_N, F.lit("fewer than 3 values"))
        .when(flat, F.lit("all values equal"))
        .when(F.col("n") > HIGHEST_N, F.lit("p extrapolated beyond 5000 values"))
    )
    sizes = sizes.withColumn("reason", reason)
    usable = sizes.filter((F.col("n") >= LOWEST_N) & ~flat).select(SLICE, "_mean")
    counts = sorted_counts(value_counts(df, by, value))
    table = stage(ranked(join_stats(counts, usable)))
    gap = F.col(VALUE) - F.col("_mean")
    spread = table.groupBy(SLICE).agg(
        F.first(TOTAL).cast("double").alias("_size"),
        F.sum(F.col(COUNT) * gap * gap).alias("_xx"),
        at_position(F.lit(0)).alias("_x1"),
        at_position(F.lit(1)).alias("_x2"),
        at_position(F.col(TOTAL) - 2).alias("_y2"),
        at_position(F.col(TOTAL) - 1).alias("_y1"),
    )
    spread = stage(spread)  # one row for each slice, read three times
    sums = spread.join(_score_products(table), SLICE).join(_score_squares(spread.select(SLICE, "_size")), SLICE)
    n, ss = F.col("_size"), F.col("_ss")
    sums = _with_score(_with_score(sums, n, n, "_m1"), n - 1, n, "_m2").withColumn("_u", F.lit(1.0) / F.sqrt(n))
    m1, m2, u = F.col("_m1"), F.col("_m2"), F.col("_u")
    a1 = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(_poly(LAST_WEIGHT, u) + m1 / F.sqrt(ss))
    a2 = F.when(n > 5, _poly(NEXT_WEIGHT, u) + m2 / F.sqrt(ss))
    sums = sums.withColumns({"_a1": a1, "_a2": a2})
    a1, a2 = F.col("_a1"), F.col("_a2")
    phi = F.when(
        n > 5, ratio(ss - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * a1 * a1 - 2 * a2 * a2)
    ).when(n > 3, ratio(ss - 2 * m1 * m1, 1 - 2 * a1 * a1))
    outer, inner = F.col("_y1") - F.col("_x1"), F.col("_y2") - F.col("_x2")
    middle = F.col("_mx") - m1 * outer - F.when(n > 5, m2 * inner).otherwise(F.lit(0.0))
    top = (
        a1 * outer
        + F.when(n > 5, a2 * inner).otherwise(F.lit(0.0))
        + F.when(n > 3, middle / F.sqrt(phi)).otherwise(F.lit(0.0))
    )
    sums = sums.withColumn("w", ratio(top * top, F.col("_xx")))
    sums = sums.withColumn("w", F.when(F.col("w") > 1, F.lit(1.0)).otherwise(F.col("w")))
    w, log_n = F.col("w"), F.ln(n)
    log_rest = F.ln(F.when(w < 1, 1 - w))
    sums = sums.withColumn("_log_rest", log_rest)
    log_rest = F.col("_log_rest")
    small_z = (-F.ln(_poly(SMALL_SHIFT, n) - log_rest) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_LOG_SD, n))
    large_z = (log_rest - _poly(LARGE_MEAN, log_n)) / F.exp(_poly(LARGE_LOG_SD, log_n))
    sums = sums.withColumn("_z", F.when(n <= 11, small_z).otherwise(large_z))
    p3 = F.greatest(
        F.lit(0.0), F.lit(6.0 / math.pi) * (F.asin(F.sqrt(w)) - F.lit(math.asin(math.sqrt(0.75))))
    )
    p = (
        F.when(w >= 1, F.lit(1.0))
        .when(n == 3, p3)
        .when((n <= 11) & (log_rest >= _poly(SMALL_SHIFT, n)), F.lit(1e-99))
        .otherwise(normal_sf("_z"))
    )
    tested = sums.select(SLICE, "w", p.alias("p"))
    return sizes.join(tested, SLICE, "left").select(*from_slice(by), "n", "w", "p", "reason")


def shapiro_residuals(df: DataFrame, by, factors, value: str) -> DataFrame:
    """Shapiro-Wilk on the residuals of the cell-mean model, one row per slice."""
    return shapiro(residuals(df, by, factors, value), by, "residual")
