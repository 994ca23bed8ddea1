"""Analysis of variance, Levene's test, correlation and the simple line."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.scalar import number, ratio
from ..functions.tails import f_sf, t_quantile, t_two_sided
from ..sources.staging import stage
from .ordering import COUNT, GROUP, VALUE, join_stats, quantile_aggs, ranked, sorted_counts, value_counts
from .slices import SLICE, add_stats, from_slice, names, slice_key

# Residual variation below this share of the total counts as none.
DUST = 1e-12


def _oneway(cells: DataFrame) -> DataFrame:
    """One-way table from (slice, group) cells with `_size`, `_mean`, `_within` (squares inside the cell)."""
    whole = Window.partitionBy(SLICE)
    size = F.col("_size").cast("double")
    grand = F.sum(size * F.col("_mean")).over(whole) / F.sum(size).over(whole)
    gap = F.col("_mean") - F.col("_grand")
    table = (
        cells.withColumn("_grand", grand)
        .groupBy(SLICE)
        .agg(
            F.sum("_size").alias("n"),
            F.sum(size * gap * gap).alias("ss_group"),
            F.sum("_within").alias("ss_resid"),
            (F.count(F.lit(1)) - 1).alias("df_group"),
            (F.sum("_size") - F.count(F.lit(1))).alias("df_resid"),
        )
    )
    ms_group = ratio(F.col("ss_group"), F.col("df_group").cast("double"))
    ms_resid = ratio(F.col("ss_resid"), F.col("df_resid").cast("double"))
    solid = (F.col("df_resid") > 0) & (
        F.col("ss_resid") > F.lit(DUST) * (F.col("ss_resid") + F.col("ss_group"))
    )
    table = table.withColumns({"ms_group": ms_group, "ms_resid": ms_resid})
    f = F.when(solid, ratio(F.col("ms_group"), F.col("ms_resid")))
    return table.withColumn("f", f).withColumn(
        "p", f_sf(F.col("f"), F.col("df_group").cast("double"), F.col("df_resid").cast("double"))
    )


_ONEWAY = ["n", "df_group", "ss_group", "ms_group", "df_resid", "ss_resid", "ms_resid", "f", "p"]


def _cells(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    rows = df.select(
        slice_key(by).alias(SLICE), F.col(group).alias(GROUP), number(value).alias(VALUE)
    ).filter(F.col(VALUE).isNotNull() & F.col(GROUP).isNotNull())
    return rows.groupBy(SLICE, GROUP).agg(
        F.count(F.lit(1)).alias("_size"),
        F.avg(VALUE).alias("_mean"),
        (F.count(F.lit(1)) * F.var_pop(VALUE)).alias("_within"),
    )


def anova_oneway(df: DataFrame, by, group: str, value: str) -> DataFrame:
    """One row per slice: sums of squares, mean squares, F and p of `value ~ group`."""
    by = names(by)
    return _oneway(_cells(df, by, group, value)).select(*from_slice(by), *_ONEWAY)


def levene(df: DataFrame, by, group: str, value: str, center: str = "median") -> DataFrame:
    """Levene's test: one-way analysis of the absolute distance from the group median (or mean)."""
    by = names(by)
    cell = [*by, group]
    counts = sorted_counts(value_counts(df.filter(F.col(group).isNotNull()), cell, value))
    ends = (F.min(VALUE).alias("_low"), F.max(VALUE).alias("_high"))
    if center == "median":
        centres = ranked(counts).groupBy(SLICE).agg(*quantile_aggs({"_centre": 0.5}), *ends)
    elif center == "mean":
        mean = F.sum(F.col(VALUE) * F.col(COUNT)) / F.sum(COUNT)
        centres = counts.groupBy(SLICE).agg(mean.alias("_centre"), *ends)
    else:
        raise ValueError(f"unknown center {center!r}")
    n = F.col(COUNT).cast("double")
    distance = F.abs(F.col(VALUE) - F.col("_centre"))
    # distances are summed from the greatest of the cell, so that far clusters lose no digits
    most = F.greatest(F.col("_high") - F.col("_centre"), F.col("_centre") - F.col("_low"))
    short = distance - most
    cells = (
        join_stats(counts, centres)
        .groupBy(SLICE)
        .agg(
            F.sum(COUNT).alias("_size"),
            F.sum(n * short).alias("_s1"),
            F.sum(n * short * short).alias("_s2"),
            F.first(most).alias("_most"),
            F.first(F.greatest(F.abs("_low"), F.abs("_high"))).alias("_scale"),
        )
    )
    size = F.col("_size").cast("double")
    within = F.col("_s2") - F.col("_s1") * F.col("_s1") / size
    rounding = size * F.pow(F.col("_scale") * F.lit(4e-16), F.lit(2))
    inner = F.struct(*[F.col(SLICE)[b].alias(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    cells = cells.select(
        inner.alias(SLICE),
        "_size",
        (F.col("_most") + F.col("_s1") / size).alias("_mean"),
        F.when(within > F.greatest(rounding, F.lit(DUST) * F.col("_s2")), within).otherwise(F.lit(0.0)).alias("_within"),
    )
    return _oneway(cells).select(*from_slice(by), *_ONEWAY)


def _terms(factors: list[str], interactions: bool) -> list[tuple[int, ...]]:
    top = len(factors) if interactions else 1
    return [c for size in range(1, top + 1) for c in combinations(range(len(factors)), size)]


def _factor_cells(df: DataFrame, by: list[str], factors: list[str], value: str) -> DataFrame:
    rows = df.select(*by, *[F.col(f).cast("string").alias(f) for f in factors], number(value).alias(VALUE))
    rows = rows.dropna(subset=[*factors, VALUE])
    return rows.groupBy(*by, *factors).agg(
        F.count(F.lit(1)).alias("_size"),
        F.avg(VALUE).alias("_mean"),
        (F.count(F.lit(1)) * F.var_pop(VALUE)).alias("_within"),
    )


#: A pivot below this share of its column's weight counts as none: the column lies in the span of earlier ones.
ALIASED = 1e-9


def swept(size: int, i, j, products, responses) -> np.ndarray:
    """What each column takes of the response, in order, after the columns before it; -1 for a column without a pivot.

    `products` are the cross-products of columns i <= j (0 where absent), `responses` those of columns and response.
    """
    matrix = np.zeros((size, size))
    matrix[i, j] = products
    matrix[j, i] = products
    left = np.array(responses, float)
    weight = matrix.diagonal().copy()
    out = np.full(size, -1.0)
    for k in range(size):
        pivot = matrix[k, k]
        if pivot <= ALIASED * weight[k]:
            continue
        out[k] = left[k] ** 2 / pivot
        share = matrix[k + 1 :, k] / pivot
        rows = np.flatnonzero(share)
        matrix[k + 1 + rows, k + 1 :] -= share[rows, None] * matrix[k, k + 1 :]
        left[k + 1 :] -= share * left[k]
    return out


@pandas_udf(T.ArrayType(T.DoubleType()))
def _swept(size: pd.Series, i: pd.Series, j: pd.Series, products: pd.Series, responses: pd.Series) -> pd.Series:
    return pd.Series([swept(int(n), *rest) for n, *rest in zip(size, i, j, products, responses)])


def _swept_terms(cells: DataFrame, terms: list[tuple[int, ...]], names_of: list[str]) -> DataFrame:
    """(slice, term number, df, ss) of the terms in their order, from cells with `_gap`, their mean less the grand mean.

    The columns of the model are the intercept and an indicator for each combination of levels that a term has. A cell lies in
    one column of each term, so the cross-products are sums of cell sizes over pairs of columns, added up by Spark.
    """
    size = F.col("_size").cast("double")
    columns = [F.struct(F.lit(0).alias("term"), F.array().cast("array<string>").alias("key"))]
    columns += [F.struct(F.lit(k).alias("term"), F.array(*[names_of[f] for f in term]).alias("key")) for k, term in enumerate(terms, 1)]
    spread = cells.select(SLICE, size.alias("_w"), (size * F.col("_gap")).alias("_y"), F.array(*columns).alias("_in"))
    order = Window.partitionBy(SLICE).orderBy("_c")
    numbers = spread.select(SLICE, F.explode("_in").alias("_c"), "_y").groupBy(SLICE, "_c").agg(F.sum("_y").alias("_y"))
    numbers = stage(numbers.withColumn("_k", F.row_number().over(order) - 1))
    pairs = F.explode(F.flatten(F.transform("_in", lambda a, n: F.transform(F.slice("_in", n + 1, len(columns)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    products = spread.select(SLICE, "_w", pairs.alias("_ab")).groupBy(SLICE, "_ab").agg(F.sum("_w").alias("_w"))

    def number(side: str) -> DataFrame:
        return numbers.select(SLICE, F.col("_c").alias(f"_{side}"), F.col("_k").alias(f"_k{side}"))

    products = products.select(SLICE, "_w", F.col("_ab.a").alias("_a"), F.col("_ab.b").alias("_b")).join(number("a"), [SLICE, "_a"]).join(number("b"), [SLICE, "_b"])
    entries = products.groupBy(SLICE).agg(F.sort_array(F.collect_list(F.struct("_ka", "_kb", "_w"))).alias("_m"))
    sides = numbers.groupBy(SLICE).agg(F.sort_array(F.collect_list(F.struct("_k", "_y", "_c.term"))).alias("_v"))
    table = sides.join(entries, SLICE)
    found = _swept(F.size("_v"), F.col("_m._ka"), F.col("_m._kb"), F.col("_m._w"), F.col("_v._y"))
    table = table.select(SLICE, F.explode(F.arrays_zip(found.alias("ss"), F.col("_v.term").alias("term"))).alias("_c"))
    taken = F.col("_c.ss") >= 0
    return (
        table.filter("_c.term > 0")
        .groupBy(SLICE, F.col("_c.term").alias("term_ord"))
        .agg(F.count(F.when(taken, 1)).alias("df"), F.coalesce(F.sum(F.when(taken, F.col("_c.ss"))), F.lit(0.0)).alias("ss"))
    )


def anova_factorial(
    df: DataFrame, by, factors: list[str], value: str, interactions: bool = True
) -> DataFrame:
    """Sequential (type I) analysis of variance with all interactions, one row per slice and term.

    Spark reduces the rows to factor cells and these to the cross-products of the model's columns, which are swept in
    their order; a column in the span of earlier ones, as with empty cells, has no pivot and no degree of freedom. The term
    with all factors is what the cells have left, so only the terms below it have columns. A slice's row
    holds the cross-products that are not 0: at most 4 to the number of factors for each of its cells.
    """
    by, factors = names(by), list(factors)
    cells = _factor_cells(df, by, factors, value).withColumn(SLICE, slice_key(by)).drop(*by)
    size = F.col("_size").cast("double")
    grand = F.sum(size * F.col("_mean")).over(Window.partitionBy(SLICE)) / F.sum(size).over(Window.partitionBy(SLICE))
    cells = stage(cells.withColumn("_gap", F.col("_mean") - grand))
    terms = _terms(factors, interactions)
    whole = len(terms[-1]) == len(factors)
    totals = cells.groupBy(SLICE).agg(
        F.sum("_size").alias("_n"), F.count(F.lit(1)).alias("_cells"), F.sum(size * F.col("_gap") * F.col("_gap")).alias("_between"), F.sum("_within").alias("_within")
    )
    below = terms[:-1] if whole else terms
    used = _swept_terms(cells, below, factors) if below else totals.select(SLICE, F.lit(1).alias("term_ord"), F.lit(0).cast("long").alias("df"), F.lit(0.0).alias("ss")).limit(0)
    used = used.groupBy(SLICE).agg(F.collect_list(F.struct("term_ord", "df", "ss")).alias("_used"))
    table = totals.join(used, SLICE, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<struct<term_ord:int,df:bigint,ss:double>>")))
    table = table.withColumns(
        {
            "_df": F.aggregate("_used", F.lit(0).cast("long"), lambda a, t: a + t["df"]),
            "_left": F.greatest(F.lit(0.0), F.col("_between") - F.aggregate("_used", F.lit(0.0), lambda a, t: a + t["ss"])),
        }
    )

    def row(k: int, df_: Column, ss: Column) -> Column:
        return F.struct(F.lit(k).alias("term_ord"), df_.cast("long").alias("df"), ss.alias("ss"))

    if whole:
        top, rest = row(len(terms), F.col("_cells") - 1 - F.col("_df"), F.col("_left")), row(len(terms) + 1, F.col("_n") - F.col("_cells"), F.col("_within"))
        rows = F.concat("_used", F.array(top, rest))
    else:
        rows = F.concat("_used", F.array(row(len(terms) + 1, F.col("_n") - 1 - F.col("_df"), F.col("_within") + F.col("_left"))))
    table = table.withColumn("_rest", F.element_at(rows, -1)).select(SLICE, "_between", "_within", "_rest", F.inline(rows))
    solid = (F.col("_rest.df") > 0) & (F.col("_rest.ss") > F.lit(DUST) * (F.col("_between") + F.col("_within")))
    is_term = F.col("term_ord") <= len(terms)
    label = F.element_at(F.array(*[F.lit(":".join(factors[f] for f in t)) for t in terms], F.lit("Residuals")), F.col("term_ord"))
    ms = ratio(F.col("ss"), F.col("df").cast("double"))
    f = F.when(solid & is_term, ratio(ms, ratio(F.col("_rest.ss"), F.col("_rest.df").cast("double"))))
    table = table.select(*from_slice(by), label.alias("term"), "term_ord", "df", "ss", ms.alias("ms"), f.alias("f"), F.col("_rest.df").cast("double").alias("_df"))
    return table.withColumn("p", f_sf(F.col("f"), F.col("df").cast("double"), F.col("_df"))).drop("_df")


def anova_first_and_residual(df: DataFrame, by, factors: list[str], value: str) -> DataFrame:
    """The order-free ends of the factorial table: first factor, all cells, residual. Pure aggregation."""
    by = names(by)
    cells = _factor_cells(df, by, factors, value)
    size = F.col("_size").cast("double")
    whole, first = Window.partitionBy(SLICE), Window.partitionBy(SLICE, factors[0])
    weighted = size * F.col("_mean")
    cells = (
        cells.withColumn(SLICE, slice_key(by))
        .withColumn("_grand", F.sum(weighted).over(whole) / F.sum(size).over(whole))
        .withColumn("_first", F.sum(weighted).over(first) / F.sum(size).over(first))
    )

    def squares(gap: Column) -> Column:
        return F.sum(size * gap * gap)

    return (
        cells.groupBy(SLICE)
        .agg(
            F.sum("_size").alias("n"),
            F.count(F.lit(1)).alias("cells"),
            squares(F.col("_first") - F.col("_grand")).alias("ss_first"),
            squares(F.col("_mean") - F.col("_grand")).alias("ss_cells"),
            F.sum("_within").alias("ss_resid"),
        )
        .select(
            *from_slice(by), "n", "cells", "ss_first", "ss_cells", "ss_resid",
            (F.col("n") - F.col("cells")).alias("df_resid"),
        )
    )


def residuals(df: DataFrame, by, factors, value: str) -> DataFrame:
    """Fitted value (cell mean) and residual next to each complete row, with the standardised residual.

    The cell mean is the fitted value of a one-way model and of a model with all
    interactions. `std_residual` divides by the residual sd and the leverage 1/n
    of the cell, as in a normal plot of a fitted model.
    """
    by, factors = names(by), names(factors)
    rows = df.dropna(subset=[*factors, value])
    rows = rows.filter(number(value).isNotNull())
    cell = [*by, *factors]
    v = number(value)
    cells = rows.groupBy(*cell).agg(
        F.avg(v).alias("fitted"), F.count(F.lit(1)).alias("_size"), (F.count(F.lit(1)) * F.var_pop(v)).alias("_ss")
    )
    whole = Window.partitionBy(slice_key(by))
    spare = F.sum("_size").over(whole) - F.count(F.lit(1)).over(whole)
    noise = F.sqrt(ratio(F.sum("_ss").over(whole), F.when(spare > 0, spare.cast("double"))))
    scale = noise * F.sqrt(F.when(F.col("_size") > 1, 1 - F.lit(1.0) / F.col("_size")))
    stats = cells.select(slice_key(cell).alias(SLICE), "fitted", scale.alias("_scale"))
    table = add_stats(rows, cell, stats).withColumn("residual", v - F.col("fitted"))
    return table.withColumn("std_residual", ratio(F.col("residual"), F.col("_scale"))).drop("_scale")


def _complete_pairs(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.select(*by, number(x).alias("_x"), number(y).alias("_y")).dropna(subset=["_x", "_y"])


def pearson(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Correlation of complete pairs with t, df = n - 2 and two-sided p, which is 0 for r = +-1 (t is NULL there)."""
    by = names(by)
    table = _complete_pairs(df, by, x, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("r")
    )
    r, df_ = F.col("r"), F.col("n") - 2
    t = F.when(df_ > 0, r * F.sqrt(ratio(df_.cast("double"), F.when(r * r < 1, 1 - r * r))))
    exact = (r * r >= 1) & (df_ > 0)
    return table.withColumn("t", t).withColumn("df", df_).withColumn(
        "p", F.when(exact, F.lit(0.0)).otherwise(t_two_sided(F.col("t"), F.col("df").cast("double")))
    )


def ols_line(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Least-squares line per slice: slope, intercept, R2, residual sd and the sums its band needs."""
    by = names(by)
    table = _complete_pairs(df, by, x, y).groupBy(*by).agg(
        F.regr_count("_y", "_x").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.regr_avgx("_y", "_x").alias("x_mean"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
    )
    left = F.col("_syy") - F.col("slope") * F.col("_sxy")
    left = F.when(left < 0, F.lit(0.0)).otherwise(left)
    spare = F.when(F.col("n") > 2, (F.col("n") - 2).cast("double"))
    return table.withColumn("resid_sd", F.sqrt(ratio(left, spare))).drop("_syy", "_sxy")


def fit_band(df: DataFrame, by, x: str, y: str, points: int = 80, level: float = 0.95) -> DataFrame:
    """The fitted line and its confidence band on an even grid over the range of x."""
    by = names(by)
    line = ols_line(df, by, x, y).withColumn(
        "_t", t_quantile(F.lit(0.5 + level / 2), (F.col("n") - 2).cast("double"))
    )
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    grid = line.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("x_min") + F.col("_i") * step)
    gap = F.col("x") - F.col("x_mean")
    half = F.col("_t") * F.col("resid_sd") * F.sqrt(F.lit(1.0) / F.col("n") + ratio(gap * gap, F.col("sxx")))
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    return grid.select(*by, "x", fit.alias("fit"), (fit - half).alias("lo"), (fit + half).alias("hi"))
