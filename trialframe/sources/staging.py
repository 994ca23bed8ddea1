"""Written intermediate tables.

A staged table is computed once, survives the loss of executors, and carries its
true file size, so Spark itself decides whether a join against it is a broadcast
(`spark.sql.autoBroadcastJoinThreshold`) or a shuffle join with skew splitting.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: `spark.checkpoint.dir`; where it is unset, the session's warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet and read it back.

    Without `path` the table goes to the shared folder, under one folder per
    application, which may be dropped when the application has ended.
    """
    spark = df.sparkSession
    target = path or f"{shared_dir(spark)}/trialframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("overwrite" if path else "error").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
