"""Rank tests: Kruskal-Wallis, Dunn and pairwise rank-sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import chi2_sf, normal_two_sided
from ..functions.scalar import ratio
from ..functions.tails import EXACT_ROWS, rank_sum_exact
from ..sources.staging import stage
from .multiple import adjust_p, pair_up
from .ordering import BELOW, CHUNK, COUNT, GROUP, TIES, VALUE, chunk_ranks, chunked, value_counts
from .slices import SLICE, from_slice, names


def _group_ranks(df: DataFrame, by, group: str, value: str) -> DataFrame:
    """(slice, group): rows, rank sum, tie sum of t^3 - t; one pass, no self-join."""
    table = chunk_ranks(chunked(value_counts(df, by, value, group)))
    n, ties = F.col(COUNT).cast("double"), F.col(TIES).cast("double")
    chunks = table.groupBy(SLICE, CHUNK, GROUP).agg(
        F.sum(COUNT).alias("_n"),
        F.sum(n * (F.col(BELOW) + (ties + 1) / 2)).alias("_ranks"),
        F.sum(n * (ties * ties - 1)).alias("_ties"),
    )
    order = Window.partitionBy(SLICE).orderBy(CHUNK)
    upto = F.sum("_n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    here = F.sum("_n").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    chunks = chunks.select("*", upto.alias("_upto"), here.alias("_here"))
    chunks = chunks.withColumn("_offset", F.col("_upto") - F.col("_here"))
    return chunks.groupBy(SLICE, GROUP).agg(
        F.sum("_n").alias("_size"),
        F.sum(F.col("_ranks") + F.col("_n").cast("double") * F.col("_offset")).alias("_ranks"),
        F.sum("_ties").alias("_ties"),
    )


def _with_slice_totals(groups: DataFrame) -> DataFrame:
    whole = Window.partitionBy(SLICE)
    return groups.withColumns(
        {
            "_rows": F.sum("_size").over(whole).cast("double"),
            "_tie_sum": F.sum("_ties").over(whole),
        }
    )


def _kruskal_aggs() -> list[Column]:
    """H is summed as squared distances of mean ranks from their centre, which does not cancel at large n."""
    n = F.first("_rows")
    centre = (F.col("_rows") + 1) / 2
    distance = F.col("_ranks") / F.col("_size") - centre
    spread = F.lit(12.0) * F.sum(F.col("_size") * distance * distance)
    correction = F.lit(1.0) - ratio(F.first("_tie_sum"), n * n * n - n)
    h = ratio(ratio(spread, n * (n + 1)), F.when(correction > 1e-12, correction))
    levels = F.count(F.lit(1))
    return [
        F.sum("_size").alias("n"),
        levels.alias("groups"),
        F.when(levels > 1, h).alias("statistic"),
        (levels - 1).alias("df"),
    ]


def kruskal(df: DataFrame, by, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, degrees of freedom and p, one row per slice."""
    by = names(by)
    table = _with_slice_totals(_group_ranks(df, by, group, value)).groupBy(SLICE).agg(*_kruskal_aggs())
    return table.select(
        *from_slice(by), "n", "groups", "statistic", "df", chi2_sf("statistic", "df").alias("p")
    )


def dunn(df: DataFrame, by, group: str, value: str, adjust: str = "bh") -> DataFrame:
    """Dunn's test for every pair of groups: z from mean ranks over the whole slice, two-sided p."""
    by = names(by)
    groups = _with_slice_totals(_group_ranks(df, by, group, value)).withColumn(
        "_mean", F.col("_ranks") / F.col("_size")
    )
    pairs = pair_up(groups, ["_size", "_mean"], ["_rows", "_tie_sum"])
    n = F.col("_rows")
    variance = (n * (n + 1) / 12 - ratio(F.col("_tie_sum"), F.lit(12.0) * (n - 1))) * (
        F.lit(1.0) / F.col("_a._size") + F.lit(1.0) / F.col("_b._size")
    )
    z = (F.col("_a._mean") - F.col("_b._mean")) / F.sqrt(F.when(variance > 1e-9, variance))
    table = pairs.select(
        *from_slice(by), F.col("_a._group").alias("g1"), F.col("_b._group").alias("g2"), z.alias("z")
    ).withColumn("p", normal_two_sided("z"))
    return adjust_p(table, by, "p", adjust)


#: Numbers in the tables of one step of the ordered pass.
CELLS = 1 << 21


def pair_counts(place: np.ndarray, level: np.ndarray, n: np.ndarray, levels: int, ties: bool, only: int | None, block: int) -> Iterator[tuple]:
    """(i, j, wins, cross) as arrays, from rows in the order of their place, for pairs i < j of levels or (only, j).

    wins: for each row of level i the rows of level j below it, and half of those at its place if `ties`; cross: what the
    places add to the tie sum of the pair. One pass over the places keeps the running count of each level.
    """
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(place))
    step = max(1, CELLS // max(1, levels))
    for first in range(0, levels, block) if only is None else [only]:
        own = slice(first, min(first + block, levels) if only is None else first + 1)
        wins = np.zeros((own.stop - own.start, levels))
        cross = np.zeros_like(wins)
        running = np.zeros(levels)
        for s in range(0, len(starts), step):
            rows = slice(starts[s], ends[min(s + step, len(starts)) - 1])
            at = np.cumsum(np.append(0, place[rows][1:] != place[rows][:-1]))
            here = np.zeros((at[-1] + 1, levels))
            here[at, level[rows]] = n[rows]
            below = running + np.cumsum(here, axis=0) - here
            running = running + here.sum(axis=0)
            wins += here[:, own].T @ (below + here / 2 if ties else below)
            if ties:
                cross += 3 * ((here[:, own] ** 2).T @ here + here[:, own].T @ here**2)
        i, j = np.meshgrid(np.arange(own.start, own.stop), np.arange(levels), indexing="ij")
        keep = (j > i) if only is None else (j != i)
        yield i[keep], j[keep], wins[keep], cross[keep]


def _pass(rows: DataFrame, keys: list[str], place: str, ties: bool, ref, block: int) -> DataFrame:
    """`pair_counts` on the rows of each key, which has bounded rows; levels are named by their group."""
    schema = T.StructType([rows.schema[SLICE], *[T.StructField(c, rows.schema[GROUP].dataType) for c in ("g1", "g2")]])
    schema = schema.add("_wins", "double").add("_cross", "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        groups = pa.compute.unique(table.column(GROUP))
        groups = groups.take(pa.compute.sort_indices(groups))
        level = np.asarray(pa.compute.index_in(table.column(GROUP), groups), dtype=np.int64)
        where = np.asarray(table.column(place))
        order = np.argsort(where, kind="stable")
        only = None
        if ref is not None:
            only = groups.to_pylist().index(ref) if ref in groups.to_pylist() else -1
        found = [] if only == -1 else list(pair_counts(where[order], level[order], np.asarray(table.column(COUNT), dtype=float)[order], len(groups), ties, only, block))
        i, j, wins, cross = (np.concatenate([f[k] for f in found]) if found else np.empty(0, t) for k, t in enumerate((np.int64, np.int64, float, float)))
        slices = table.column(SLICE).combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
        return pa.table([slices, groups.take(pa.array(i)), groups.take(pa.array(j)), pa.array(wins), pa.array(cross)], names=[SLICE, "g1", "g2", "_wins", "_cross"])

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _pair_sums(table: DataFrame, ref, block: int) -> DataFrame:
    """(slice, g1, g2): half-tie wins of g1 over g2 and cross tie sum, for g1 < g2, or for g1 = ref.

    Inside the chunks one ordered pass counts all pairs that meet there; a pass of the same kind over the counts of
    (chunk, level) adds the rows of earlier chunks. The plan does not depend on the number of levels.
    """
    inside = _pass(table.select(SLICE, CHUNK, GROUP, VALUE, COUNT), [SLICE, CHUNK], VALUE, True, ref, block)
    counts = table.groupBy(SLICE, CHUNK, GROUP).agg(F.sum(COUNT).alias(COUNT))
    sums = inside.unionByName(_pass(counts, [SLICE], CHUNK, False, ref, block))
    return sums.groupBy(SLICE, "g1", "g2").agg(F.sum("_wins").alias("_wins"), F.sum("_cross").alias("_cross"))


def rank_sum_z(w: Column, n1: Column, n2: Column, tie_sum: Column) -> Column:
    """z of the rank-sum statistic, with continuity correction and ties in the variance."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ratio(tie_sum, n * (n - 1)))
    distance = w - n1 * n2 / 2
    corrected = F.signum(distance) * F.greatest(F.abs(distance) - 0.5, F.lit(0.0))
    return corrected / F.sqrt(F.when(variance > 1e-9, variance))


def pairwise_ranksum(
    df: DataFrame,
    by,
    group: str,
    value: str,
    adjust: str = "bh",
    ref: str | None = None,
    exact: bool = True,
    block: int = 1024,
) -> DataFrame:
    """Wilcoxon rank-sum for every pair of groups, ranked inside each pair.

    With `ref`, only the pairs (ref, other) are tested. With `exact`, pairs
    without ties and with fewer than 50 rows on each side take the exact
    distribution; all others the normal approximation. Any number of groups is
    handled by the same plan; a task counts `block` levels against all others at a time.
    """
    by = names(by)
    table = stage(chunked(value_counts(df, by, value, group)))
    n = F.col(COUNT).cast("double")
    levels = table.groupBy(SLICE, GROUP).agg(F.sum(COUNT).alias("_size"), F.sum(n * n * n - n).alias("_own"))

    def side(g: str, k: int) -> DataFrame:
        return levels.select(SLICE, F.col(GROUP).alias(g), F.col("_size").alias(f"n{k}"), F.col("_own").alias(f"_own{k}"))

    pairs = _pair_sums(table, ref, block).join(side("g1", 1), [SLICE, "g1"]).join(side("g2", 2), [SLICE, "g2"])
    tie_sum = F.col("_own1") + F.col("_own2") + F.col("_cross")
    out = pairs.select(
        *from_slice(by),
        "g1",
        "g2",
        "n1",
        "n2",
        F.col("_wins").alias("w"),
        rank_sum_z(F.col("_wins"), F.col("n1"), F.col("n2"), tie_sum).alias("z"),
        ((tie_sum == 0) & (F.col("n1") < EXACT_ROWS) & (F.col("n2") < EXACT_ROWS)).alias("_exact"),
    )
    out = out.withColumn("p", normal_two_sided("z"))
    if exact:
        small = F.when(F.col("_exact"), F.col("w"))
        out = out.withColumn(
            "p",
            F.coalesce(rank_sum_exact(small, F.col("n1").cast("double"), F.col("n2").cast("double")), F.col("p")),
        )
    return adjust_p(out.drop("_exact"), by, "p", adjust)
