"""Chart annotation: an omnibus p per slice and stars of each group against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import chi2_sf, normal_two_sided
from ..functions.scalar import star_code
from ..functions.tails import EXACT_ROWS, rank_sum_exact
from .ordering import GROUP
from .ranktests import _group_ranks, _kruskal_aggs, _with_slice_totals, pairwise_ranksum, rank_sum_z
from .slices import SLICE, from_slice, names


def omnibus(df: DataFrame, by, group: str, value: str, exact: bool = True) -> DataFrame:
    """Kruskal-Wallis p per slice; with two groups the rank-sum p, whose ranks are the same.

    With `exact`, two small groups without ties take the exact distribution.
    """
    by = names(by)
    groups = _with_slice_totals(_group_ranks(df, by, group, value))
    table = groups.groupBy(SLICE).agg(
        *_kruskal_aggs(),
        F.sort_array(F.collect_list(F.struct(GROUP, "_size", "_ranks"))).alias("_levels"),
        F.first("_tie_sum").alias("_tie_sum"),
    )
    first, second = F.col("_levels")[0], F.get("_levels", F.lit(1))
    n1 = first["_size"].cast("double")
    w = first["_ranks"] - n1 * (n1 + 1) / 2
    n2 = second["_size"].cast("double")
    table = table.withColumn("_z", rank_sum_z(w, n1, n2, F.col("_tie_sum")))
    two = normal_two_sided("_z")
    if exact:
        small = (F.col("groups") == 2) & (F.col("_tie_sum") == 0) & (n1 < EXACT_ROWS) & (n2 < EXACT_ROWS)
        table = table.withColumn("_exact", rank_sum_exact(F.when(small, w), n1, n2))
        two = F.coalesce(F.col("_exact"), two)
    p = F.when(F.col("groups") == 2, two).otherwise(chi2_sf("statistic", "df"))
    method = F.when(F.col("groups") == 2, "rank-sum").otherwise("kruskal")
    return table.select(*from_slice(by), method.alias("method"), "groups", p.alias("p"))


def compare_means(df: DataFrame, by, group: str, value: str, ref: str | None = None, exact: bool = True) -> DataFrame:
    """One omnibus row per slice and, with `ref`, one row per other group; p is not adjusted."""
    by = names(by)
    if ref is not None:
        df = df.select(*dict.fromkeys([*by, group, value]))  # read by two plans
    none = F.lit(None).cast("string")
    table = omnibus(df, by, group, value, exact).select(
        *by, "method", none.alias("g1"), none.alias("g2"), "p"
    )
    if ref is not None:
        pairs = pairwise_ranksum(df, by, group, value, adjust="none", ref=ref, exact=exact)
        table = table.unionByName(
            pairs.select(*by, F.lit("rank-sum").alias("method"), "g1", "g2", "p")
        )
    return table.withColumn("stars", star_code(F.col("p")))


def stars_vs_reference(df: DataFrame, by, group: str, value: str, ref: str, exact: bool = True) -> DataFrame:
    """Each group of a slice against the reference group: rank-sum W, z, unadjusted p and stars."""
    pairs = pairwise_ranksum(df, by, group, value, adjust="none", ref=ref, exact=exact)
    return pairs.drop("p_adj").withColumn("stars", star_code(F.col("p")))
