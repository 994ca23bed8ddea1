"""Cleaning and reshaping: recode, project, rename, order categories, unpivot, filter."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number
from ..sources.staging import stage
from .ordering import BELOW, COUNT, VALUE, quantiles, ranked, sorted_counts
from .slices import SLICE, add_stats, names, slice_key


def recode(
    df: DataFrame, col: str, mapping: Mapping[str, str], out: str, default: str | None = None
) -> DataFrame:
    """Map codes to labels; codes outside the map become `default` (NULL)."""
    label = F.lit(default).cast("string")
    for code, text in reversed(list(mapping.items())):
        label = F.when(F.col(col) == F.lit(code), F.lit(text)).otherwise(label)
    return df.withColumn(out, label)


def recode_from(df: DataFrame, col: str, table: DataFrame, code: str, label: str, out: str) -> DataFrame:
    """Map codes through a map table of any size (unique codes); Spark picks the join by its size."""
    right = table.select(F.col(code).alias("_code"), F.col(label).alias(out))
    return df.join(right, F.col(col) == F.col("_code"), "left").drop("_code")


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add or replace columns by expressions over the incoming columns."""
    return df.withColumns(exprs)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.drop(*columns)


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def select_positions(df: DataFrame, keep: Sequence[int | str] = (), drop: Sequence[int | str] = ()) -> DataFrame:
    """Keep or drop columns by 1-based position, mixed with names; resolved when the plan is built."""

    def resolve(items):
        out = [df.columns[i - 1] if isinstance(i, int) else i for i in items]
        return list(dict.fromkeys(out))

    if any(isinstance(i, int) and not 1 <= i <= len(df.columns) for i in [*keep, *drop]):
        raise ValueError("position outside the table")
    kept = resolve(keep) if keep else df.columns
    gone = set(resolve(drop))
    return df.select(*[c for c in kept if c not in gone])


def move_column(df: DataFrame, col: str, before: str) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    at = rest.index(before)
    return df.select(*rest[:at], col, *rest[at:])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; `mapping` is old name -> new name."""
    return df.withColumnsRenamed(dict(mapping))


def clean_name(name: str) -> str:
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("%", "_percent_").replace("#", "_number_").replace("'", "").replace('"', "")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case, ASCII, unique column names; a repeated name gets _2, _3, ..."""
    taken: dict[str, int] = {}
    out = []
    for name in map(clean_name, df.columns):
        taken[name] = taken.get(name, 0) + 1
        out.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
    return df.toDF(*out)


def as_factor(df: DataFrame, col: str, by=None, out: str = "level_ord") -> DataFrame:
    """Text category with its 1-based place among the sorted levels of the slice; NULL has no place."""
    by = names(by)
    df = df.withColumn(col, F.col(col).cast("string"))
    levels = (
        df.filter(F.col(col).isNotNull())
        .select(slice_key(by).alias(SLICE), F.col(col).alias(VALUE))
        .distinct()
        .withColumn(COUNT, F.lit(1).cast("long"))
    )
    # numbered like values of a column, so that many levels do not meet in one task
    places = ranked(sorted_counts(levels)).select(
        SLICE, F.col(VALUE).alias(col), (F.col(BELOW) + 1).cast("int").alias(out)
    )
    return df.withColumn(SLICE, slice_key(by)).join(stage(places), [SLICE, col], "left").drop(SLICE)


def with_level_order(df: DataFrame, col: str, levels: Sequence[str], out: str = "level_ord") -> DataFrame:
    """Explicit 1-based category order; unlisted values get NULL."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(col))
    return df.withColumn(out, F.when(place > 0, place).cast("int"))


def level_medians(df: DataFrame, col: str, value: str, desc: bool = True, by=None) -> DataFrame:
    """One row per slice and level with its median and its place by median; ties keep alphabetical order."""
    by = names(by)
    medians = quantiles(df.filter(F.col(col).isNotNull()), [*by, col], value, {"median": 0.5})
    key = F.col("median").desc_nulls_last() if desc else F.col("median").asc_nulls_last()
    order = Window.partitionBy(slice_key(by)).orderBy(key, F.col(col))
    return medians.withColumn("level_ord", F.row_number().over(order))


def reorder_levels(
    df: DataFrame, col: str, by_value: str, desc: bool = True, out: str = "level_ord", by=None
) -> DataFrame:
    """Number the categories of a slice by the median of a value and put the number next to each row."""
    keys = [*names(by), col]
    places = level_medians(df, col, by_value, desc, by).select(
        slice_key(keys).alias(SLICE), F.col("level_ord").alias(out)
    )
    return add_stats(df, keys, places)


def flag_threshold(df: DataFrame, col: str, cut: float, out: str = "flag") -> DataFrame:
    """0 below the cut, 1 at or above it, NULL for a missing value (NULL or NaN)."""
    c = number(col)
    return df.withColumn(out, F.when(c < cut, F.lit(0)).when(c >= cut, F.lit(1)))


def to_long(
    df: DataFrame, ids: Sequence[str], names_to: str, values_to: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Wide to long; `values` defaults to every column that is not an id. No shuffle."""
    columns = list(values) if values else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), columns, names_to, values_to)


def complete_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is missing (NULL or NaN)."""
    return df.dropna(subset=list(columns))


def distinct_first(df: DataFrame, key, order) -> DataFrame:
    """One row per key, all columns kept, the first by `order`.

    The rank limit is applied before the shuffle, so a hot key sends one row per
    input partition.
    """
    place = F.row_number().over(Window.partitionBy(*names(key)).orderBy(*names(order)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def count_by(df: DataFrame, keys, out: str = "n") -> DataFrame:
    return df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias(out))
