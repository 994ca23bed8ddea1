"""Readers, writers and the schema profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import COLLECTION


def read_table(
    spark: SparkSession,
    root: str,
    name: str | int,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Load one table of a collection folder by name, or by its 1-based place.

    With a schema, missing or differently typed Parquet columns are an error and
    CSV text is parsed as declared (no inference pass over the data).
    """
    if isinstance(name, int):
        name, declared = COLLECTION[name]
        schema = schema or declared
    base = f"{root.rstrip('/')}/{name}"
    if fmt == "parquet":
        df = spark.read.parquet(f"{base}.parquet")
        return df if schema is None else _conform(df, schema, name)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return (
            spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{base}.csv")
        )
    raise ValueError(f"unknown format {fmt!r}")


def _conform(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Check the declared columns and turn NaN into NULL, so that a missing number has one form."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"table {name}: columns missing or of another type: {wrong}")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, non-null rows, approximate distinct values.

    One scan; the single wide result row is unpivoted into the report.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        aggs += [
            F.count(F.col(f"`{field.name}`")).alias(f"n{i}"),
            F.approx_count_distinct(F.col(f"`{field.name}`")).alias(f"d{i}"),
        ]
    entries = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("rows"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"d{i}").alias("approx_distinct"),
        )
        for i, field in enumerate(df.schema)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def sort_table(df: DataFrame, keys: list[str], desc: bool = False, nulls: str = "last") -> DataFrame:
    """Order a report table; nulls go last by default in both directions."""
    way = ("desc" if desc else "asc") + f"_nulls_{nulls}"
    return df.orderBy(*[getattr(F.col(k), way)() for k in keys])


def write_csv(df: DataFrame, path: str, order_by: list[str], desc: bool = True) -> None:
    """Write a summary as one headed, sorted CSV file. For result-sized tables."""
    (
        sort_table(df, order_by, desc=desc)
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Write a table of any size, optionally laid out by slice key so later reads prune."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_chart_data(df: DataFrame, path: str) -> None:
    """Persist the table behind a chart."""
    write_table(df, path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
