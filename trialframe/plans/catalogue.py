"""The registered queries: each operator bound to the benchmark tables.

The assay is `lineitem` joined to `orders`: line status is the pathogen, return
flag the experiment, order priority the treatment, quantity the diameter.
Doubles are rounded at the end only, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as op
from ..functions import log10_or_null, normal_two_sided, star_code, with_p_value
from ..sources import profile_schema, read_table, shared_dir, sort_table, stage, write_chart_data, write_csv, write_table
from . import reports

BY = ["pathogen", "experiment"]
TREATMENT = "treatment"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, special.get(c, places)) for c in doubles})


def assay(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item. `diam_shift` adds a small known treatment effect."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    step = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_linestatus").alias("pathogen"),
        F.col("l_returnflag").alias("experiment"),
        F.col("o_orderpriority").alias("treatment"),
        F.col("l_quantity").alias("diam_mm"),
        F.col("l_extendedprice").alias("value2"),
        (F.col("l_quantity") + F.lit(0.4) * step).alias("diam_shift"),
    )


# ---------------------------------------------------------------- responses and summaries


@query
def inhibition_summary(spark, sf):
    """Flagship: percent inhibition against the slice maximum, summarised by treatment."""
    return rounded(op.inhibition_summary(assay(spark, sf), BY, TREATMENT, "diam_mm"))


@query
def inhibition_pooled_max(spark, sf):
    return rounded(op.inhibition_summary(assay(spark, sf), ["pathogen"], TREATMENT, "diam_mm"))


@query
def inhibition_experiment_max_pooled(spark, sf):
    """Experiments pooled, each row still relative to the maximum of its own experiment."""
    return rounded(
        op.inhibition_summary(assay(spark, sf), ["pathogen"], TREATMENT, "diam_mm", max_by=BY)
    )


@query
def inhibition_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity"
    )
    return rounded(op.inhibition_pct(lines, ["l_linestatus", "l_returnflag"], "l_quantity"))


@query
def sliced_and_pooled(spark, sf):
    return rounded(op.sliced_and_pooled(assay(spark, sf), "pathogen", "experiment", TREATMENT, "diam_mm"))


@query
def treatment_summary(spark, sf):
    return rounded(op.treatment_summary(assay(spark, sf), BY, TREATMENT, "value2"))


@query
def transforms(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("diam_mm")
    )
    plain = op.transforms(lines, "diam_mm")
    return rounded(plain.withColumn("log1_diam", log10_or_null(F.greatest(F.col("diam_mm"), F.lit(0.0)), 1.0)))


@query
def window_aggregates(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    top = op.window_agg(events, "event_type", "value", "max", "top")
    return rounded(op.window_agg(top, "event_type", "value", "mean", "average"))


# ---------------------------------------------------------------- cleaning and reshaping


@query
def recode_labels(spark, sf):
    labels = {"AUTOMOBILE": "car", "BUILDING": "house", "MACHINERY": "machine"}
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return op.recode(customers, "c_mktsegment", labels, "label")


@query
def recode_from_table(spark, sf):
    nations = table(spark, sf, "nation")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return op.recode_from(customers, "c_nationkey", nations, "n_nationkey", "n_name", "nation")


@query
def derived_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    q = F.col("l_quantity")
    return rounded(op.derive(lines, diam=q * 2 - 5, doubled=q * 2, weighted=q * F.col("l_discount")))


@query
def select_positions(spark, sf):
    return op.select_positions(table(spark, sf, "part"), keep=[1, "p_brand", 5], drop=["p_size"])


@query
def drop_columns(spark, sf):
    return op.drop_columns(table(spark, sf, "supplier"), ["s_name", "s_acctbal"])


@query
def keep_columns(spark, sf):
    return op.keep_columns(table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority", "o_totalprice"])


@query
def move_and_rename(spark, sf):
    moved = op.move_column(table(spark, sf, "supplier"), "s_acctbal", before="s_name")
    return op.rename(moved, {"s_acctbal": "balance", "s_name": "supplier_name"})


@query
def clean_names(spark, sf):
    messy = table(spark, sf, "supplier").toDF("Supplier Key", "supplierKey", "Nation-Key (id)", "% Balance")
    return op.clean_names(messy)


@query
def factor_levels(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return op.as_factor(orders, "o_orderpriority", "o_orderstatus")


@query
def level_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return op.with_level_order(orders, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])


@query
def reorder_levels(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return op.reorder_levels(orders, "o_orderpriority", "o_totalprice")


@query
def level_medians(spark, sf):
    return rounded(op.level_medians(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query
def to_long(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity"
    )
    return op.to_long(lines, ["l_orderkey", "l_linenumber"], "measure", "value")


@query
def baseline_delta(spark, sf):
    """Mean price per supplier and line number, as the change from line 1, in long form."""
    lines = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    wide = lines.groupBy("l_suppkey").agg(
        *[F.avg(F.when(F.col("l_linenumber") == k, price)).alias(f"day{k}") for k in range(1, 8)]
    )
    return rounded(op.series_change(wide, ["l_suppkey"], [f"day{k}" for k in range(1, 8)], "day", "weight"), 4)


@query
def baseline_delta_long(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value")
    return rounded(op.baseline_delta_long(events, "user_id", "event_id", "value"))


@query
def filter_slice(spark, sf):
    return op.slice_by(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"),
        l_linestatus="F",
        l_returnflag="A",
    )


@query
def filters_in_notnull_range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return (
        op.complete_on(orders, ["o_orderpriority"])
        .filter(F.col("o_orderstatus") != "P")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "5-LOW"))
        .filter(F.col("o_totalprice") > 100000)
    )


@query
def filter_factor_number(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("dpi"), "l_quantity"
    )
    return lines.filter(F.col("dpi").cast("int") == 7)


@query
def flag_threshold(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return op.flag_threshold(events, "value", 20.0, "present")


@query
def distinct_first_count(spark, sf):
    events = op.complete_on(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"])
    first = op.distinct_first(events.filter(F.col("event_type") != "purchase"), "user_id", "event_id")
    return op.count_by(first, "event_type")


@query
def distinct_first_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return op.distinct_first(events, ["user_id", "event_type"], "event_id")


@query
def profile(spark, sf):
    """Column names, types and counts; the approximate distinct count differs by engine and is left out."""
    return profile_schema(table(spark, sf, "customer")).select("position", "column", "rows", "non_null")


@query
def declared_table(spark, sf):
    """A table loaded by name with a declared schema, which is checked."""
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    return op.count_by(read_table(spark, sf, "customer", schema).filter(F.col("c_acctbal") > 0), "c_mktsegment")


@query
def partitioned_table(spark, sf):
    """A table laid out by slice and read back, one slice of it."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    write_table(lines, path, partition_by=["l_returnflag"])
    return op.slice_by(spark.read.schema(lines.schema).parquet(path), l_returnflag="A")


@query
def chart_table(spark, sf):
    """The table behind a chart, written and read back."""
    path = f"{shared_dir(spark)}/chart-{uuid.uuid4().hex}"
    bars = rounded(op.mean_se(table(spark, sf, "events"), [], "event_type", None, "value"))
    write_chart_data(bars, path)
    return spark.read.schema(bars.schema).parquet(path)


@query
def staged_reread(spark, sf):
    """The cleaned table is written once and read back before it is sliced."""
    lines = stage(table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity"))
    return op.count_by(op.slice_by(lines, l_linestatus="F"), "l_returnflag")


@query
def csv_round_trip(spark, sf):
    """A sorted summary written as one headed CSV file and read back."""
    summary = rounded(op.treatment_summary(table(spark, sf, "customer"), [], "c_mktsegment", "c_acctbal"))
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    write_csv(summary, path, ["mean"])
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@query
def sorted_report(spark, sf):
    orders = op.count_by(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])
    return sort_table(orders, ["n", "o_orderpriority"], desc=True)


@query
def order_index(spark, sf):
    return op.order_index(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


# ---------------------------------------------------------------- rates, indices, summaries


@query
def germination_rate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    rated = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(op.germination_rate(rated, ["source", "lang"], "quality", offset=0.5))


@query
def incidence(spark, sf):
    return rounded(op.incidence_pct(assay(spark, sf), [TREATMENT, "pathogen"], "diam_mm", 10.0))


def _ratings(spark, sf):
    scale = (F.col("p_size") % 5 + 1).alias("rating_scale")
    parts = table(spark, sf, "part").select(F.col("p_type").alias("treatment"), "p_brand", scale)
    return parts.groupBy("treatment", "p_brand", "rating_scale").agg(
        F.count(F.lit(1)).alias("total_rating")
    )


@query
def severity_index(spark, sf):
    return rounded(op.severity_index(_ratings(spark, sf), ["treatment"], "rating_scale", "total_rating"))


@query
def severity_window(spark, sf):
    return rounded(op.severity_window(_ratings(spark, sf), ["treatment"], "rating_scale", "total_rating"))


@query
def prescreen_summary(spark, sf):
    parts = table(spark, sf, "part").withColumn("diam_mm", F.col("p_retailprice") * 2)
    return rounded(op.treatment_summary(parts, ["p_brand", "p_type"], "p_size", "diam_mm"))


@query
def summary_stats(spark, sf):
    return rounded(op.summary_stats(table(spark, sf, "events"), "event_type", "value"))


def _with_nan(spark, sf):
    """The assay with NaN in place of the greatest diameters."""
    rows = assay(spark, sf)
    return rows.withColumn("diam_mm", F.when(F.col("diam_mm") > 45, float("nan")).otherwise(F.col("diam_mm")))


@query
def nan_summary(spark, sf):
    """NaN counts as missing: left out of mean, sd and n."""
    return rounded(op.treatment_summary(_with_nan(spark, sf), BY, TREATMENT, "diam_mm", null_policy="skip"))


@query
def nan_inhibition(spark, sf):
    """NaN is no maximum and no response."""
    return rounded(op.inhibition_summary(_with_nan(spark, sf), BY, TREATMENT, "diam_mm", null_policy="skip"))


@query
def nan_flags(spark, sf):
    """NaN is neither above nor below the cut, and propagates to a group's rate."""
    rows = _with_nan(spark, sf).filter((F.col("treatment") != "5-LOW") | (F.col("value2") < 20000))
    flags = op.flag_threshold(rows, "diam_mm", 10.0, "flag").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    rates = op.incidence_pct(rows, [TREATMENT, "pathogen"], "diam_mm", 10.0)
    return rounded(rates.select(TREATMENT, "pathogen", "n", "incidence").unionByName(
        flags.select(F.lit("flag").alias(TREATMENT), F.col("flag").cast("string").alias("pathogen"), "n", F.lit(None).cast("double").alias("incidence"))
    ))


@query
def mean_se(spark, sf):
    return rounded(op.mean_se(assay(spark, sf), "pathogen", TREATMENT, "experiment", "diam_mm"))


@query
def describe(spark, sf):
    return rounded(op.describe(table(spark, sf, "events"), "event_type", "value"))


@query
def shape_stats(spark, sf):
    return rounded(op.shape_stats(assay(spark, sf), BY, "value2"))


@query
def quantiles(spark, sf):
    return rounded(op.quantiles(assay(spark, sf), BY, "value2", {"q1": 0.25, "median": 0.5, "q9": 0.9}))


@query
def midrank(spark, sf):
    return op.midrank(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"], "l_quantity")


@query
def outliers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return op.identify_outliers(events, "event_type", "value")


# ---------------------------------------------------------------- linear models


@query
def anova_oneway(spark, sf):
    return rounded(op.anova_oneway(assay(spark, sf), BY, TREATMENT, "diam_shift"), 4)


@query
def levene(spark, sf):
    return rounded(op.levene(table(spark, sf, "events"), [], "event_type", "value"), 4)


@query
def levene_sliced(spark, sf):
    return rounded(op.levene(assay(spark, sf), BY, TREATMENT, "diam_shift"), 4)


@query
def anova_factorial(spark, sf):
    return rounded(op.anova_factorial(assay(spark, sf), [], [TREATMENT, *BY], "diam_shift"), 4)


@query
def anova_two_factors(spark, sf):
    return rounded(op.anova_factorial(assay(spark, sf), [], [TREATMENT, "pathogen"], "diam_shift"), 4)


@query
def anova_factorial_ends(spark, sf):
    return rounded(op.anova_first_and_residual(assay(spark, sf), [], [TREATMENT, *BY], "diam_shift"), 4)


@query
def anova_empty_cells(spark, sf):
    """Unbalanced, and without rows in some combinations of levels."""
    rows = assay(spark, sf).filter(
        ~((F.col("pathogen") == "F") & F.col("treatment").isin("1-URGENT", "5-LOW"))
        & ~((F.col("experiment") == "R") & (F.col("treatment") == "2-HIGH"))
        & ~((F.col("experiment") == "N") & (F.col("pathogen") == "O") & (F.col("diam_mm") > 9))
    )
    return rounded(op.anova_factorial(rows, [], [TREATMENT, *BY], "diam_shift"), 4)


@query
def anova_sliced(spark, sf):
    """A factorial table for each slice, main effects only."""
    return rounded(op.anova_factorial(assay(spark, sf), ["pathogen"], ["experiment", TREATMENT], "diam_shift", interactions=False), 4)


@query
def p_values(spark, sf):
    """Tails put next to the statistics of a result table, from each of the four distributions."""
    table_ = op.anova_oneway(assay(spark, sf), BY, TREATMENT, "diam_shift").select(*BY, "f", "df_group", "df_resid")
    table_ = table_.withColumns({"z": F.sqrt("f"), "x2": F.col("f") * F.col("df_group")})
    table_ = with_p_value(table_, "f", "f", "df_group", "df_resid", out="p_f")
    table_ = with_p_value(table_, "t", "z", "df_resid", out="p_t")
    table_ = with_p_value(table_, "chi2", "x2", "df_group", out="p_chi2")
    return rounded(with_p_value(table_, "normal", "z", out="p_normal").drop("z", "x2"), 4)


@query
def residuals(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(op.residuals(customers, [], "c_mktsegment", "c_acctbal"))


@query
def resid_data(spark, sf):
    rows = assay(spark, sf).select(*BY, TREATMENT, "value2")  # read twice: cells, then rows
    return rounded(op.resid_data(rows, BY, TREATMENT, "value2"), 4)


@query
def pearson(spark, sf):
    return rounded(op.pearson(assay(spark, sf), BY, "diam_mm", "value2"), 6)


@query
def ols_line(spark, sf):
    return rounded(op.ols_line(assay(spark, sf), BY, "diam_mm", "value2"), 4)


@query
def fit_band(spark, sf):
    return rounded(op.fit_band(assay(spark, sf), BY, "diam_mm", "value2"), 4)


# ---------------------------------------------------------------- rank tests


@query
def kruskal(spark, sf):
    return rounded(op.kruskal(assay(spark, sf), BY, TREATMENT, "diam_shift"))


@query
def kruskal_untied(spark, sf):
    return rounded(op.kruskal(assay(spark, sf), ["pathogen"], "experiment", "value2"))


@query
def pairwise_ranksum(spark, sf):
    return rounded(op.pairwise_ranksum(assay(spark, sf), BY, TREATMENT, "diam_shift"))


@query
def dunn_bh(spark, sf):
    return rounded(op.dunn(assay(spark, sf), BY, TREATMENT, "diam_shift"))


@query
def group_pairs(spark, sf):
    return op.group_pairs(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query
def vs_reference(spark, sf):
    return op.vs_reference(table(spark, sf, "events"), "event_type", "view")


@query
def adjust_bh(spark, sf):
    lines = op.kruskal(table(spark, sf, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity")
    return rounded(op.adjust_bh(lines.select("l_linenumber", "p"), [], "p"))


@query
def adjust_bh_parts(spark, sf):
    """A family with one p for each part: is its mean quantity that of all quantities 1 to 50?"""
    parts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("z", (F.col("m") - 25.5) * F.sqrt("n") / 14.43)
    return rounded(op.adjust_bh(parts.select("l_partkey", normal_two_sided("z").alias("p")), [], "p"))


@query
def pairwise_ranksum_nations(spark, sf):
    """All pairs of 25 groups."""
    return rounded(op.pairwise_ranksum(table(spark, sf, "customer"), [], "c_nationkey", "c_acctbal", exact=False))


@query
def full_pairs(spark, sf):
    return rounded(op.full_pairs(op.dunn(assay(spark, sf), BY, TREATMENT, "diam_shift"), BY))


@query
def pair_matrix(spark, sf):
    full = op.full_pairs(op.dunn(assay(spark, sf), ["pathogen"], "experiment", "diam_shift"), ["pathogen"])
    return rounded(op.pair_matrix(full, ["pathogen"], ["A", "N", "R"]))


@query
def compact_letters(spark, sf):
    return op.compact_letters(op.dunn(assay(spark, sf), BY, TREATMENT, "diam_shift"), BY)


@query
def summary_with_letters(spark, sf):
    return rounded(reports.lettered_summary(assay(spark, sf), BY, TREATMENT, "diam_shift", "dunn"))


@query
def vs_reference_stars(spark, sf):
    return rounded(op.stars_vs_reference(table(spark, sf, "events"), [], "event_type", "value", "view"))


@query
def compare_means(spark, sf):
    return rounded(op.compare_means(assay(spark, sf), BY, TREATMENT, "diam_shift", ref="1-URGENT"))


@query
def compare_two_groups(spark, sf):
    """Two groups per slice, so the omnibus test is the rank-sum test."""
    return rounded(op.omnibus(assay(spark, sf), ["experiment"], "pathogen", "diam_mm"))


# ---------------------------------------------------------------- normality


@query
def shapiro(spark, sf):
    return rounded(op.shapiro(table(spark, sf, "customer"), [], "c_acctbal"))


@query
def shapiro_ties(spark, sf):
    """Many rows of few different values."""
    return rounded(op.shapiro(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


@query
def shapiro_by_group(spark, sf):
    return rounded(op.shapiro(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query
def shapiro_residuals(spark, sf):
    return rounded(op.shapiro_residuals(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal"))


# ---------------------------------------------------------------- chart tables


@query
def histogram(spark, sf):
    return rounded(op.hist_data(table(spark, sf, "events"), [], "value", facet="event_type"))


@query
def boxplot(spark, sf):
    return rounded(op.box_data(table(spark, sf, "events"), "event_type", "value"))


@query
def qq(spark, sf):
    return rounded(op.qq_data(table(spark, sf, "events"), "event_type", "value"))


@query
def qq_residuals(spark, sf):
    return rounded(op.qq_residuals(table(spark, sf, "customer"), [], "c_mktsegment", "c_acctbal"), 5)


@query
def bars(spark, sf):
    summary = reports.lettered_summary(assay(spark, sf), "pathogen", TREATMENT, "diam_shift", "ranksum")
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return rounded(op.bar_data(summary, TREATMENT, levels=levels, by="pathogen"))


@query
def grouped_bars(spark, sf):
    rows = assay(spark, sf)
    return rounded(
        op.grouped_bar_data(rows, ["pathogen"], TREATMENT, "experiment", "diam_shift", ref="1-URGENT")
    )


def _yearly(spark, sf, key: str, columns: list[str]) -> DataFrame:
    """Mean order value per key, a column for each year from 1995 on."""
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    price = F.col("o_totalprice")
    return orders.groupBy(key).agg(
        *[F.avg(F.when(F.col("year") == 1995 + k, price)).alias(c) for k, c in enumerate(columns)]
    )


@query
def grouped_bars_fill(spark, sf):
    """Stars of each experiment against one of them, inside each treatment."""
    rows = assay(spark, sf)
    bars = op.grouped_bar_data(rows, ["pathogen"], TREATMENT, "experiment", "diam_shift", fill_ref="A")
    return rounded(bars.select("pathogen", TREATMENT, "experiment", "mean", "n", "ord", "fill_p", "fill_stars"))


@query
def scatter_points(spark, sf):
    positive = assay(spark, sf).filter(F.col("diam_mm") > 45)
    return op.scatter_fit_data(positive, "pathogen", "diam_mm", "value2")["points"]


@query
def scatter_band(spark, sf):
    return rounded(op.scatter_fit_data(assay(spark, sf), "pathogen", "diam_mm", "value2")["band"], 4)


@query
def germination_offsets(spark, sf):
    """Both offsets: on the rate and on the standard error."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rated = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(op.germination_rate(rated, "lang", "quality", offset=1.0, se_offset=1.0))


@query
def lines(spark, sf):
    """Order value per priority and year, as the change from the first year."""
    years = [f"day{k}" for k in range(1, 8)]
    return rounded(op.series_data(_yearly(spark, sf, "o_orderpriority", years), "o_orderpriority", years, "day", "weight"), 4)


@query
def scatter_label(spark, sf):
    positive = assay(spark, sf).filter(F.col("diam_mm") > 0)
    label = op.scatter_fit_data(positive, "pathogen", "diam_mm", "value2")["label"]
    return rounded(label.withColumn("stars", star_code(F.col("p"))))


# ---------------------------------------------------------------- whole reports


def _isolate(place):
    """The first isolate codes of the strain table, by the order priority."""
    return F.element_at(F.array(*[F.lit(c) for c in list(reports.STRAINS)[:5]]), place.cast("int"))


def _confrontation(spark, sf):
    """The assay in the raw schema of the confrontation table."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    day = F.to_date("l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        _isolate(first).alias("isolate_id"),
        F.col("l_linestatus").alias("pathogen"),
        F.col("l_returnflag").alias("experiment"),
        ((F.col("l_quantity") + F.lit(0.4) * (first.cast("int") - 1) + 5) / 2).alias("radius_mm"),
        F.col("l_discount").alias("inhibition_zone"),
        F.col("l_tax").alias("yeast_diameter"),
        F.lit(7).alias("dpi"),
        day.alias("inoc_date"),
        day.alias("col_date"),
    )


@query
def confrontation_clean(spark, sf):
    clean = reports.clean_confrontation(_confrontation(spark, sf))
    return rounded(
        clean.groupBy("treatmnt", *BY).agg(
            F.count(F.lit(1)).alias("n"),
            F.max("max_diam").alias("max_diam"),
            F.avg("perc_in").alias("perc_in"),
            F.avg("log_fdiam").alias("log_fdiam"),
            F.avg("sqrt_fdiam").alias("sqrt_fdiam"),
            F.max("iz").alias("iz"),
            F.max("ydiam_mm").alias("ydiam_mm"),
        )
    )


@query
def confrontation_summary(spark, sf):
    """Raw table to lettered summary: clean, stage, rank-sum pairs, letters, pooled over experiments."""
    clean = stage(reports.clean_confrontation(_confrontation(spark, sf)))
    return rounded(reports.lettered_summary(clean, "pathogen", "treatmnt", "perc_in", "ranksum"))


@query
def germination_summary(spark, sf):
    """Wide table to long, Dunn letters and germination rate per pathogen and strain."""
    lines = table(spark, sf, "lineitem")
    raw = lines.select(
        F.col("l_linenumber").alias("experiment"),
        F.col("l_linestatus").alias("pathogen"),
        (F.col("l_quantity") > 25).cast("double").alias("sdw"),
        (F.col("l_discount") > 0.05).cast("double").alias("wcs"),
        (F.col("l_tax") > 0.05).cast("double").alias("cfs"),
        F.col("l_returnflag").alias("yeast_id"),
        F.lit(1).alias("reps"),
        F.lit("").alias("spare_1"),
        F.lit("").alias("spare_2"),
    )
    rows = stage(reports.clean_germination(raw))
    by = ["pathogen", "yeast_id"]
    letters = op.compact_letters(op.dunn(rows, by, "treatmnt", "value"), by)
    rates = op.germination_rate(rows, [*by, "treatmnt"], "value", offset=1.0)
    return rounded(op.attach_letters(rates, letters, by, "treatmnt"))


@query
def severity_tests(spark, sf):
    """Severity index per treatment and pathogen, tested between pathogens."""
    parts = table(spark, sf, "part").select(
        F.col("p_type").alias("pathogen"),
        F.col("p_brand").alias("treatment"),
        (F.col("p_size") % 5 + 1).alias("rating_scale"),
        (F.col("p_partkey") % 4 + 1).alias("total_rating"),
    )
    index = op.severity_index(parts, ["treatment", "pathogen"], "rating_scale", "total_rating")
    return rounded(op.kruskal(index, [], "pathogen", "dis_sev"))


@query
def screened_isolates(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("isolate"),
        F.when(F.col("event_type") == "error", "bacteria").otherwise("yeast").alias("organism"),
        F.when(F.col("event_type") == "signup", "Control").otherwise(F.col("event_type")).alias("name"),
    )
    return reports.screened_table(raw)


@query
def prescreen_table(spark, sf):
    """Mean diameter per pre-screened isolate of one pathogen, bacteria left out."""
    parts = table(spark, sf, "part")
    raw = parts.select(
        F.col("p_brand").alias("Sample"),
        F.col("p_type").alias("Isolate"),
        F.col("p_size").cast("string").alias("Name"),
        F.when(F.col("p_partkey") % 2 == 0, "Bc").otherwise("Cf").alias("Pathogen"),
        F.when(F.col("p_partkey") % 5 == 0, "bacteria").otherwise("yeast").alias("Organism"),
        (F.col("p_retailprice") / 100).alias("Radius mm"),
    )
    return rounded(reports.prescreen_table(raw, "Bc"))


@query
def fermentation_lines(spark, sf):
    raw = _yearly(spark, sf, "o_orderstatus", [f"day{k}" for k in range(1, 8)])
    return rounded(reports.fermentation_lines(raw.withColumnRenamed("o_orderstatus", "strain")), 4)


def _diameters(spark, sf):
    """The assay in the raw schema of the pathogen-on-yeast table."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    day = F.to_date("l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        _isolate(first).alias("isolate_id"),
        F.col("l_linestatus").alias("pathogen"),
        F.col("l_returnflag").alias("experiment"),
        (F.col("l_quantity") + F.lit(0.4) * (first.cast("int") - 1) + 5).alias("diam_mm"),
        day.alias("inoc_date"),
        day.alias("col_date"),
    )


@query
def diameter_summary(spark, sf):
    """Raw diameters to lettered summary: one maximum over all experiments, Dunn pairs, letters."""
    by = ["pathogen"]
    clean = stage(reports.relative_response(reports.clean_diameter(_diameters(spark, sf), ["inoc_date", "col_date"]), by))
    return rounded(reports.lettered_summary(clean, by, "treatmnt", "perc_in", "dunn"))


def _lesions(spark, sf):
    """Line items in the raw schema of the lesion table; two line numbers are no analysed treatment."""
    codes = ["357", "506", "707", "957", "461", "none", "other"]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        code.alias("treatment"),
        F.col("l_quantity").alias("av_ld"),
        F.when(F.col("l_linestatus") == "F", "Botrytis").otherwise("Colletotrichum").alias("pathogen"),
        F.when(F.col("l_returnflag") == "A", 4).otherwise(7).alias("dpi"),
    )


@query
def lesion_anova(spark, sf):
    """The three-factor table of the lesion report."""
    lesions = reports.clean_lesions(_lesions(spark, sf))
    return rounded(op.anova_factorial(lesions, [], ["treatment", "pathogen", "dpi"], "av_ld"), 4)


@query
def lesion_kruskal(spark, sf):
    """Its omnibus test of the treatments inside each pathogen."""
    return rounded(op.kruskal(reports.clean_lesions(_lesions(spark, sf)), ["pathogen"], "treatment", "av_ld"))


@query
def incidence_table(spark, sf):
    """Percent of late lesions of at least 20 per treatment and pathogen, from the incidence report."""
    return rounded(reports.incidence_report(reports.clean_lesions(_lesions(spark, sf)), cut=20.0)["incidence"])


@query
def severity_rows(spark, sf):
    """The severity index next to every rating row, from the severity report."""
    raw = table(spark, sf, "part").select(
        F.col("p_brand").alias("treatment"),
        F.lit(7).alias("dpi"),
        F.when(F.col("p_partkey") % 2 == 0, "Botrytis").otherwise("Colletotrichum").alias("pathogen"),
        (F.col("p_size") % 5 + 1).cast("double").alias("rating_scale"),
        (F.col("p_partkey") % 4 + 1).cast("double").alias("total_rating"),
    )
    return rounded(reports.severity_report(raw, per_row=True)["severity"])


@query
def rate_pairs(spark, sf):
    """Germination rates of three yeasts per treatment: small untied groups, so most p are exact."""
    lines = table(spark, sf, "lineitem")
    rows = lines.select(
        F.col("l_linestatus").alias("pathogen"),
        F.col("l_linenumber").alias("experiment"),
        F.col("l_returnflag").alias("yeast_id"),
        F.explode(
            F.array(
                F.struct(F.lit("sdw").alias("treatmnt"), F.col("l_extendedprice").alias("value")),
                F.struct(F.lit("wcs").alias("treatmnt"), (F.col("l_extendedprice") * F.col("l_discount") * 20).alias("value")),
            )
        ).alias("r"),
    ).select("pathogen", "experiment", "yeast_id", "r.*")
    rates = stage(op.germination_rate(rows, ["pathogen", "experiment", "yeast_id", "treatmnt"], "value"))
    return rounded(reports.compare_rates(rates))
