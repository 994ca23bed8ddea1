"""Pairs of groups, multiplicity adjustment, pair tables and compact letters.

All tables here are result-sized: one row per slice and pair of treatment levels.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.scalar import number
from ..sources.staging import stage
from .slices import SLICE, from_slice, names, slice_key, with_slice

# The letters of a compact display, in the order they are given out.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pair_up(groups: DataFrame, payload: list[str], per_slice: list[str] | None = None) -> DataFrame:
    """All unordered pairs of the levels of a slice, as structs `_a` and `_b` in level order.

    The levels of a slice are packed into one sorted array and unpacked twice, so
    the plan below runs once; there is no self-join.
    """
    per_slice = per_slice or []
    packed = groups.groupBy(SLICE).agg(
        F.sort_array(F.collect_list(F.struct("_group", *payload))).alias("_levels"),
        *[F.first(c).alias(c) for c in per_slice],
    )
    first = packed.select(SLICE, *per_slice, "_levels", F.posexplode("_levels").alias("_i", "_a"))
    rest = F.slice("_levels", F.col("_i") + 2, F.size("_levels"))
    return first.select(SLICE, *per_slice, "_a", F.explode(rest).alias("_b"))


def group_pairs(df: DataFrame, by, group: str) -> DataFrame:
    """All unordered pairs of the groups present in each slice."""
    by = names(by)
    levels = (
        df.select(slice_key(by).alias(SLICE), F.col(group).alias("_group"))
        .filter(F.col("_group").isNotNull())
        .distinct()
    )
    return pair_up(levels, []).select(
        *from_slice(by), F.col("_a._group").alias("g1"), F.col("_b._group").alias("g2")
    )


def vs_reference(df: DataFrame, group: str, ref: str, by=None) -> DataFrame:
    """Each group of a slice against the reference group; slices without the reference give no pairs."""
    by = names(by)
    packed = (
        df.select(slice_key(by).alias(SLICE), F.col(group).alias("_group"))
        .filter(F.col("_group").isNotNull())
        .distinct()
        .groupBy(SLICE)
        .agg(F.collect_list("_group").alias("_levels"))
        .filter(F.array_contains("_levels", ref))
    )
    return packed.select(
        *from_slice(by), F.lit(ref).alias("g1"), F.explode(F.array_remove("_levels", ref)).alias("g2")
    )


def adjust_bh(df: DataFrame, by, p: str, out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg within each slice; a missing p (NULL or NaN) stays missing and does not count.

    A family may have any size. The rows are range-partitioned on (slice, p), equal p's spread too; a rank is the
    place in its chunk and the rows of earlier chunks, and the least step above a row is that of the rest of its chunk and
    of later chunks. Both need one row for each slice and chunk only. Chunks are read downwards, so that each row adds to a
    running least step: a frame of the rows that follow would be read anew for each row.
    """
    by = names(by)
    table = with_slice(df, by).withColumn("_p", number(p)).withColumn("_tie", F.monotonically_increasing_id())
    order = [SLICE, F.col("_p").asc_nulls_last(), "_tie"]
    table = stage(table.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    chunk = [SLICE, "_chunk"]
    chunks = Window.partitionBy(SLICE).orderBy("_chunk")
    down = Window.partitionBy(*chunk).orderBy(F.col("_p").desc_nulls_last(), F.col("_tie").desc())
    sizes = table.groupBy(*chunk).agg(F.count("_p").alias("_rows"))
    sizes = sizes.select(*chunk, F.sum("_rows").over(chunks).alias("_upto"), F.sum("_rows").over(Window.partitionBy(SLICE)).alias("_tests"))
    step = F.col("_p") * F.col("_tests") / (F.col("_upto") + 1 - F.row_number().over(down))
    ranked = table.join(sizes, chunk).withColumn("_step", step)
    least = ranked.groupBy(*chunk).agg(F.min("_step").alias("_least"))
    later = Window.partitionBy(SLICE).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*chunk, F.min("_least").over(later).alias("_later"))
    upward = F.min("_step").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = ranked.withColumn("_least", upward).join(least, chunk)
    adjusted = F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_least"), F.col("_later")))
    return table.withColumn(out, adjusted).select(*[c for c in df.columns if c != out], out)


def adjust_p(df: DataFrame, by, p: str, method: str, out: str = "p_adj") -> DataFrame:
    if method.lower() == "bh":
        return adjust_bh(df, by, p, out)
    if method.lower() == "none":
        return df.withColumn(out, F.col(p))
    raise ValueError(f"unknown adjustment {method!r}")


def full_pairs(pairs: DataFrame, by, p: str = "p_adj") -> DataFrame:
    """The symmetric pair table with a diagonal of ones, in long form, from one pass over the pairs."""
    by = names(by)

    def entry(a, b, v):
        return F.struct(a.alias("g1"), b.alias("g2"), v.alias(p))

    g1, g2, one = F.col("g1"), F.col("g2"), F.lit(1.0)
    cells = F.array(
        entry(g1, g2, F.col(p)), entry(g2, g1, F.col(p)), entry(g1, g1, one), entry(g2, g2, one)
    )
    return pairs.select(*by, F.inline(cells)).groupBy(*by, "g1", "g2").agg(F.max(p).alias(p))


def pair_matrix(full: DataFrame, by, levels: list[str], p: str = "p_adj") -> DataFrame:
    """Display form: one row per first group, one column per listed second group."""
    return full.groupBy(*names(by), "g1").pivot("g2", levels).agg(F.first(p))


#: Pairs of sets that are compared at once, in words of 64 levels.
COMPARED = 1 << 22


def _inside(parts: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Which of the parts lie inside one of the sets; both are rows of 64-bit words."""
    out = np.zeros(len(parts), bool)
    step = max(1, COMPARED // max(1, sets.size))
    for start in range(0, len(parts), step):
        some = parts[start : start + step, None, :]
        out[start : start + step] = ((some & ~sets[None]) == 0).all(axis=2).any(axis=1)
    return out


def largest_sets(levels: int, apart: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The largest sets of levels 0, 1, ... without a pair that is apart, in the order of their levels.

    Sets are bit masks, an antichain at any time. A pair (i, j) splits the sets that hold both. What is left of one without i
    can only lie inside a set that holds j and not i and was not split, so only those are looked at; what is left of two
    sets without the same level cannot lie in one another. There may be exponentially many largest sets (3 to the third of
    the levels, for levels in threes all apart within), and the time grows with the square of their number.
    """
    words = -(-levels // 64)
    sets = np.zeros((1, words), np.uint64)
    for k in range(levels):
        sets[0, k // 64] |= np.uint64(1 << k % 64)
    for i, j in apart:
        (iw, ib), (jw, jb) = ((k // 64, np.uint64(1 << k % 64)) for k in (i, j))
        with_i, with_j = (sets[:, iw] & ib) != 0, (sets[:, jw] & jb) != 0
        split = sets[with_i & with_j]
        if not len(split):
            continue
        kept = [sets[~(with_i & with_j)]]
        for w, b, others in ((iw, ib, sets[with_j & ~with_i]), (jw, jb, sets[with_i & ~with_j])):
            part = split.copy()
            part[:, w] &= ~b
            kept.append(part[~_inside(part, others)] if len(others) else part)
        sets = np.concatenate(kept)
    return sorted([k for k in range(levels) if s[k // 64] >> np.uint64(k % 64) & np.uint64(1)] for s in sets)


def _letter(i: int) -> str:
    return "." * (i // len(LETTERS)) + LETTERS[i % len(LETTERS)]


@pandas_udf(T.ArrayType(T.StringType()))
def _letters_of(levels: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    out = []
    for n, a, b in zip(levels, first, second):
        letters = [""] * n
        for k, members in enumerate(largest_sets(int(n), zip(a.tolist(), b.tolist()))):
            for level in members:
                letters[level] += _letter(k)
        out.append(letters)
    return pd.Series(out)


def compact_letters(pairs: DataFrame, by, p: str = "p_adj", alpha: float = 0.05) -> DataFrame:
    """Letters per group: two groups share a letter exactly when their pair is not significant.

    Starting from one set with all levels, each significant pair splits the sets that hold both of its levels, and sets
    inside another set are dropped (`largest_sets`). There is no bound on the number of levels.
    """
    by = names(by)
    table = with_slice(pairs, by).groupBy(SLICE).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("g1", "g2"))))).alias("levels"),
        F.sort_array(F.collect_list(F.when(F.col(p) < alpha, F.struct("g1", "g2")))).alias("apart"),
    )
    table = table.withColumn("place", F.map_from_arrays("levels", F.sequence(F.lit(0), F.size("levels") - 1)))

    def places(g: str) -> Column:
        return F.transform("apart", lambda pair: F.element_at("place", pair[g]))

    table = table.select(SLICE, "levels", _letters_of(F.size("levels"), places("g1"), places("g2")).alias("letters"))
    return table.select(SLICE, F.inline(F.arrays_zip(F.col("levels").alias("_group"), "letters"))).select(
        *from_slice(by), F.col("_group").alias("group"), "letters"
    )


def attach_letters(summary: DataFrame, letters: DataFrame, by, group: str, out: str = "letters") -> DataFrame:
    """Join letters to a summary by slice and group, never by row position."""
    by = names(by)
    right = letters.select(
        slice_key(by).alias(SLICE), F.col("group").alias(group), F.col("letters").alias(out)
    )
    return with_slice(summary, by).join(right, [SLICE, group], "left").drop(SLICE)


