"""Order statistics and ranks that no hot slice can block.

Rows are first reduced to value counts (map-side), so ties cost nothing further.
The counts are range-partitioned on (slice, value): a slice with a third of all
values spreads over many range chunks, and equal values always share a chunk.
Inside a chunk a window gives local counts; a small table with one row per
(slice, chunk) turns local counts into positions in the whole slice. Inputs of every
size take this way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number
from ..sources.staging import stage
from .slices import SLICE, from_slice, names, slice_key

VALUE, COUNT, GROUP, CHUNK = "_value", "_n", "_group", "_chunk"
BELOW, TIES, TOTAL = "_below", "_ties", "_total"


def value_counts(df: DataFrame, by, value, group: str | None = None, weight: str | None = None) -> DataFrame:
    """(slice, [group], value, count); rows without a value or group are left out."""
    columns = [slice_key(names(by)).alias(SLICE), number(value).alias(VALUE)]
    keys = [SLICE, VALUE]
    if group:
        columns.append(F.col(group).alias(GROUP))
        keys.insert(1, GROUP)
    if weight:
        columns.append(F.col(weight).alias("_w"))
    rows = df.select(*columns).filter(F.col(VALUE).isNotNull())
    if group:
        rows = rows.filter(F.col(GROUP).isNotNull())
    n = F.sum("_w") if weight else F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias(COUNT))


def chunked(counts: DataFrame) -> DataFrame:
    """Range-partition value counts on (slice, value) and note the range of each row.

    The chunk number may be used in one pass over this plan only; stage the table
    before reading it twice, because range bounds are sampled per execution.
    """
    return counts.repartitionByRange(SLICE, VALUE).withColumn(CHUNK, F.spark_partition_id())


def sorted_counts(counts: DataFrame) -> DataFrame:
    """Counts that may be read any number of times: chunked and written."""
    return stage(chunked(counts))


def chunk_ranks(table: DataFrame) -> DataFrame:
    """Add the rows tied at each value and the rows below it, counted inside the chunk.

    Both frames belong to one window: a range frame takes in all rows of equal value.
    """
    order = Window.partitionBy(SLICE, CHUNK).orderBy(VALUE)
    upto = F.sum(COUNT).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(COUNT).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return table.select("*", upto.alias("_upto"), ties.alias(TIES)).select(
        *table.columns, TIES, (F.col("_upto") - F.col(TIES)).alias(BELOW)
    )


def chunk_offsets(table: DataFrame) -> DataFrame:
    """(slice, chunk): rows of the slice in earlier chunks, and in the whole slice."""
    totals = table.groupBy(SLICE, CHUNK).agg(F.sum(COUNT).alias("_rows"))
    earlier = Window.partitionBy(SLICE).orderBy(CHUNK)
    return totals.select(
        SLICE,
        CHUNK,
        (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(SLICE)).alias(TOTAL),
    )


def ranked(table: DataFrame) -> DataFrame:
    """Sorted counts with the rows below each value in the whole slice (`_below`), ties and slice size.

    The window and the join use the same key, so they share one shuffle.
    """
    return (
        chunk_ranks(table)
        .join(chunk_offsets(table), [SLICE, CHUNK])
        .withColumn(BELOW, F.col(BELOW) + F.col("_offset"))
        .drop("_offset", CHUNK)
    )


def join_stats(table: DataFrame, stats: DataFrame) -> DataFrame:
    """Put per-slice values next to sorted counts.

    The join key is (slice, chunk), whose rows are bounded by the range
    partitioning, so a hot slice is joined in as many tasks as it has chunks,
    whether or not the other side is small enough to be broadcast.
    """
    keyed = table.select(SLICE, CHUNK).distinct().join(stats, SLICE)
    return table.join(stage(keyed), [SLICE, CHUNK])


def at_position(position):
    """Aggregate: the value at a 0-based position of the sorted slice."""
    hit = (F.col(BELOW) <= position) & (position < F.col(BELOW) + F.col(COUNT))
    return F.max(F.when(hit, F.col(VALUE)))


def quantile_aggs(probs: dict[str, float]) -> list:
    """Exact linear-interpolation quantiles (type 7), as aggregates over a ranked table."""
    out = []
    for name, p in probs.items():
        place = (F.col(TOTAL) - 1) * F.lit(float(p))
        low, high = at_position(F.floor(place)), at_position(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append((low + share * (high - low)).alias(name))
    return out


def slice_quantiles(table: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row per slice (`_slice`) with the named quantiles, from ungrouped sorted counts."""
    return ranked(table).groupBy(SLICE).agg(*quantile_aggs(probs))


def quantiles(df: DataFrame, by, value, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per slice; `probs` maps output names to probabilities."""
    by = names(by)
    table = slice_quantiles(sorted_counts(value_counts(df, by, value)), probs)
    return table.select(*from_slice(by), *probs)


def midrank(df: DataFrame, by, value) -> DataFrame:
    """One row per slice and distinct value: its count and its average rank."""
    by = names(by)
    return ranked(sorted_counts(value_counts(df, by, value))).select(
        *from_slice(by),
        F.col(VALUE).alias(value),
        F.col(COUNT).alias("n"),
        (F.col(BELOW) + (F.col(COUNT) + 1) / 2).alias("midrank"),
    )


def order_index(df: DataFrame, by, value, block: int = 100_000) -> DataFrame:
    """One row per input row: its value, its 1-based place in the sorted slice and the slice size.

    A value tied many times is laid out in blocks that are spread before they are
    expanded, so one tied value does not expand inside one task.
    """
    by = names(by)
    table = ranked(sorted_counts(value_counts(df, by, value)))
    blocks = table.select(
        SLICE,
        VALUE,
        TOTAL,
        F.explode(
            F.sequence(F.col(BELOW) + 1, F.col(BELOW) + F.col(COUNT), F.lit(block).cast("long"))
        ).alias("_from"),
        (F.col(BELOW) + F.col(COUNT)).alias("_last"),
    ).repartition(SLICE, "_from")
    place = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (block - 1), F.col("_last"))))
    return blocks.select(SLICE, VALUE, TOTAL, place.alias("i")).select(
        *from_slice(by), F.col(VALUE).alias(value), "i", F.col(TOTAL).alias("n")
    )
