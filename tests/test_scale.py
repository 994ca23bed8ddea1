"""Plans and results under skew, many chunks and any partitioning."""

import io
from contextlib import redirect_stdout

import brute
import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from trialframe import operators as op
from trialframe.plans import catalogue
from trialframe.sources import shared_dir, stage


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_hot_slice_spreads_over_chunks(spark, staged_path):
    """One slice holds most rows and one value a third of them; ranks stay exact."""
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("s"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"),
    )
    from trialframe.operators.ordering import CHUNK, chunked, value_counts

    spread = chunked(value_counts(df, "s", "v")).filter("_slice.s = 'hot'").select(CHUNK).distinct().count()
    assert spread > 1
    pdf = df.toPandas()
    for r in op.kruskal(df, "s", "g", "v").collect():
        part = pdf[pdf.s == r.s]
        groups = {g: x.v.to_numpy() for g, x in part.groupby("g")}
        assert r.statistic == pytest.approx(brute.kruskal(groups))
    for r in op.quantiles(df, "s", "v", {"m": 0.5}).collect():
        assert r.m == np.median(pdf[pdf.s == r.s].v)


def test_row_order_and_partitions_do_not_matter(spark):
    df = lineitem(spark).select("l_returnflag", "l_linestatus", "l_quantity")
    args = ("l_linestatus", "l_returnflag", "l_quantity")
    base = rows(op.kruskal(df, *args), "l_linestatus")
    mixed = rows(op.kruskal(df.repartition(17).orderBy(F.rand(3)), *args), "l_linestatus")
    for a, b in zip(base, mixed):
        assert a["statistic"] == pytest.approx(b["statistic"], rel=1e-12)
    monotone = op.kruskal(df.withColumn("l_quantity", F.exp(F.col("l_quantity") / 10)), *args)
    for a, b in zip(base, rows(monotone, "l_linestatus")):
        assert a["statistic"] == pytest.approx(b["statistic"], rel=1e-9)


@pytest.mark.parametrize("name", [
    "describe", "kruskal", "pairwise_ranksum", "levene_sliced", "outliers", "boxplot", "histogram", "inhibition_rows",
    "residuals", "reorder_levels", "factor_levels", "qq", "midrank", "shapiro_by_group", "severity_window",
])
def test_many_chunks_give_the_same_result(spark, name, request):
    few = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
    request.getfixturevalue("staged_path")
    staged = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
    assert few == staged


def test_no_cross_join_and_no_single_partition_on_rows(spark, staged_path):
    for name in ["kruskal", "dunn_bh", "compact_letters", "quantiles", "describe", "inhibition_rows", "levene_sliced"]:
        plan = plan_of(catalogue.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "SinglePartition" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalogue.QUERIES["filter_slice"](spark, SF))
    assert "EqualTo(l_linestatus,F)" in plan and "EqualTo(l_returnflag,A)" in plan
    plan = plan_of(catalogue.QUERIES["inhibition_summary"](spark, SF))
    scan = next(x for x in plan.splitlines() if "lineitem" in x)
    assert "l_extendedprice" not in scan and "l_quantity" in scan
    # a slice is chosen before the operator: its range chunks hold back filters on the result
    one = op.slice_by(lineitem(spark), l_linestatus="F")
    ranks = op.kruskal(one, ["l_linestatus"], "l_returnflag", "l_quantity")
    assert "EqualTo(l_linestatus,F)" in plan_of(ranks)


def test_first_per_key_limits_before_the_shuffle(spark):
    plan = plan_of(catalogue.QUERIES["distinct_first_rows"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_wide_reshape_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(catalogue.QUERIES["to_long"](spark, SF))


def test_staging_uses_the_configured_folder(spark, tmp_path):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = stage(lineitem(spark))
    assert all(shared_dir(spark) in f for f in df.inputFiles())
