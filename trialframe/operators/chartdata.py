"""Tables behind charts. Facets are further `by` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import add_normal_quantile
from ..functions.scalar import number, ratio, star_code
from ..sources.staging import stage
from .clean import level_medians, with_level_order
from .compare import omnibus
from .linear import fit_band, ols_line, pearson, residuals
from .ordering import COUNT, VALUE, join_stats, order_index, slice_quantiles, sorted_counts, value_counts
from .ranktests import pairwise_ranksum
from .response import series_change
from .slices import SLICE, from_slice, joinable, names, slice_key
from .summarise import mean_se


def bar_data(
    summary: DataFrame,
    group: str,
    mean: str = "mean",
    se: str = "se",
    label: str | None = "letters",
    levels: Sequence[str] | None = None,
    by=None,
) -> DataFrame:
    """Bars or points with error bars and a letter label, in the given level order (else alphabetical)."""
    columns = [
        *names(by),
        group,
        F.col(mean).alias("mean"),
        (F.col(mean) - F.col(se)).alias("ymin"),
        (F.col(mean) + F.col(se)).alias("ymax"),
    ]
    if label:
        columns.append(F.col(label).alias("label"))
    table = summary.select(*columns)
    return with_level_order(table, group, levels, "ord") if levels else table


def box_data(df: DataFrame, by, value: str) -> DataFrame:
    """Quartiles, whisker ends (last values inside 1.5 interquartile ranges) and outlier count per slice.

    The outlier rows themselves are `identify_outliers`.
    """
    by = names(by)
    counts = sorted_counts(value_counts(df, by, value))
    quartiles = stage(slice_quantiles(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col(VALUE) >= F.col("q1") - reach) & (F.col(VALUE) <= F.col("q3") + reach)
    whiskers = (
        join_stats(counts, quartiles)
        .groupBy(SLICE)
        .agg(
            F.sum(COUNT).alias("n"),
            F.min(F.when(inside, F.col(VALUE))).alias("lower"),
            F.max(F.when(inside, F.col(VALUE))).alias("upper"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col(COUNT))).alias("outliers"),
        )
    )
    return whiskers.join(quartiles, SLICE).select(
        *from_slice(by), "n", "lower", "q1", "median", "q3", "upper", "outliers"
    )


def hist_data(df: DataFrame, by, value: str, bins: int = 30, facet=None) -> DataFrame:
    """Histogram counts on `bins` equal bins per slice, empty bins included.

    The first bin is centred on the smallest value and the last on the largest,
    and bins are closed on the right. `facet` columns share the range of their
    slice and get counts of their own. Two scans, each with map-side partials:
    the range, then the counts.
    """
    by, facet = names(by), names(facet)
    rows = df.select(
        slice_key(by).alias(SLICE), slice_key([*by, *facet]).alias("_cell"), number(value).alias(VALUE)
    ).filter(F.col(VALUE).isNotNull())
    span = (
        rows.groupBy(SLICE)
        .agg(F.min(VALUE).alias("_lo"), F.max(VALUE).alias("_hi"))
        .withColumn("_width", (F.col("_hi") - F.col("_lo")) / F.lit(float(max(bins - 1, 1))))
    )
    # fuzz as a share of the bin width keeps a value on an edge in its left bin
    spot = F.ceil(ratio(F.col(VALUE) - F.col("_lo"), F.col("_width")) + F.lit(0.5 - 1e-8))
    bin_ = F.coalesce(F.least(F.greatest(spot, F.lit(1)), F.lit(bins)), F.lit(1)).cast("int")
    filled = (
        rows.join(joinable(span, by), SLICE)
        .groupBy("_cell", bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_width").alias("_width"))
    )
    packed = filled.groupBy("_cell").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_counts"),
        F.first("_lo").alias("_lo"),
        F.first("_width").alias("_width"),
    )
    table = packed.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    edge = F.col("_lo") + (F.col("bin") - 1.5) * F.col("_width")
    columns = [F.col("_cell")[c].alias(c) for c in [*by, *facet]]
    return table.select(
        *columns,
        "bin",
        edge.alias("lo"),
        (edge + F.col("_width")).alias("hi"),
        F.coalesce(F.col("_counts")[F.col("bin")], F.lit(0)).alias("count"),
    )


def plotting_position(i: Column, n: Column) -> Column:
    a = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return (i - a) / (n + 1 - 2 * a)


def qq_data(df: DataFrame, by, value: str) -> DataFrame:
    """Normal quantile-quantile points: theoretical quantile and sample value, one per present row."""
    by = names(by)
    points = order_index(df, by, value)
    position = plotting_position(F.col("i").cast("double"), F.col("n").cast("double"))
    points = add_normal_quantile(points.withColumn("_p", position), "_p", "theoretical")
    return points.select(*by, "i", "theoretical", F.col(value).alias("sample"))


def qq_residuals(df: DataFrame, by, factors, value: str) -> DataFrame:
    """Quantile-quantile points of standardised residuals."""
    return qq_data(residuals(df, by, factors, value), by, "std_residual")


def resid_data(df: DataFrame, by, factors, value: str) -> DataFrame:
    """Residual against fitted value, one point per complete row."""
    return residuals(df, by, factors, value).select(*names(by), "fitted", "residual")


def scatter_fit_data(df: DataFrame, by, x: str, y: str) -> dict[str, DataFrame]:
    """The three tables of a scatter chart with a line: points, band and correlation label."""
    by = names(by)
    points = df.select(*by, number(x).alias("x"), number(y).alias("y")).dropna(subset=["x", "y"])
    return {
        "points": points,
        "band": fit_band(df, by, x, y),
        "line": ols_line(df, by, x, y),
        "label": pearson(df, by, x, y).select(*by, "r", "p"),
    }


def grouped_bar_data(
    df: DataFrame, by, x: str, fill: str | None, value: str, ref: str | None = None, fill_ref: str | None = None
) -> DataFrame:
    """Mean and error bar per (x, fill), with the place of x by descending median, omnibus p and stars against `ref`.

    With `fill_ref`, `fill_p` and `fill_stars` compare each level of `fill` with that one inside its x.

    Places, tests and stars belong to the slice `by`, as each slice is a chart.
    """
    by = names(by)
    df = df.select(*dict.fromkeys([*by, x, *names(fill), value]))  # read by four plans
    bars = mean_se(df, by, x, fill, value)
    places = level_medians(df, x, value, by=by).select(
        slice_key(by).alias(SLICE), x, F.col("level_ord").alias("ord")
    )
    overall = omnibus(df, by, x, value).select(slice_key(by).alias(SLICE), F.col("p").alias("p_omnibus"))
    table = bars.withColumn(SLICE, slice_key(by)).join(places, [SLICE, x], "left").join(overall, SLICE, "left")
    if ref is not None:
        pairs = pairwise_ranksum(df, by, x, value, adjust="none", ref=ref)
        stars = pairs.select(
            slice_key(by).alias(SLICE), F.col("g2").alias(x), "p", star_code(F.col("p")).alias("stars")
        )
        table = table.join(stars, [SLICE, x], "left")
    if fill_ref is not None:
        inner = pairwise_ranksum(df, [*by, x], fill, value, adjust="none", ref=fill_ref)
        inner = inner.select(
            slice_key(by).alias(SLICE), x, F.col("g2").alias(fill), F.col("p").alias("fill_p"), star_code(F.col("p")).alias("fill_stars")
        )
        table = table.join(inner, [SLICE, x, fill], "left")
    return table.drop(SLICE)


def series_data(df: DataFrame, ids, columns: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """Lines of change from the first column: series, numeric step, value, in step order."""
    return series_change(df, names(ids), columns, step, value).orderBy(*names(ids), step)
