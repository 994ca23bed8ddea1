"""The whole-experiment reports, each as one set of plans over all slices.

Every report takes the raw assay table in its declared schema and returns named
DataFrames. A report cleans its table once, stages it, and runs every check and
test off the staged table; `by` decides whether experiments are kept apart or pooled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import inhibition, log10_or_null, safe_sqrt
from ..operators import (
    anova_factorial,
    anova_oneway,
    as_factor,
    attach_letters,
    bar_data,
    box_data,
    clean_names,
    compact_letters,
    complete_on,
    count_by,
    describe,
    distinct_first,
    drop_columns,
    dunn,
    flag_threshold,
    full_pairs,
    germination_rate,
    grouped_bar_data,
    hist_data,
    identify_outliers,
    incidence_pct,
    inhibition_pct,
    kruskal,
    levene,
    move_column,
    pairwise_ranksum,
    pearson,
    qq_data,
    qq_residuals,
    recode,
    rename,
    resid_data,
    residuals,
    scatter_fit_data,
    select_positions,
    series_data,
    severity_index,
    severity_window,
    shapiro,
    summary_stats,
    to_long,
    treatment_summary,
    window_agg,
)
from ..operators.slices import names
from ..sources.staging import stage
from ..sources.tables import union_all

# Isolate codes and strain labels of the yeast assays.
STRAINS = {
    "C": "CTRL",
    "357": "JB543",
    "461": "JB524",
    "506": "JB624",
    "707": "JB767",
    "957": "JB951",
}
# Fruit treatments kept for analysis, and their labels per pathogen.
FRUIT_TREATMENTS = ["357", "506", "707", "957", "461", "SDI", "Cf", "Bc", "switch"]
FRUIT_LABELS = {
    "957": "JB951",
    "707": "JB767",
    "506": "JB624",
    "461": "JB524",
    "357": "JB543",
    "Cf": "Cf only",
    "Bc": "Bc only",
    "SDI": "SDW",
    "switch": "Switch",
    "Switch": "Switch",
}
# The untreated label each pathogen's charts compare with.
FRUIT_REFERENCES = {"Botrytis": "Bc only", "Colletotrichum": "Cf only"}
DISC_MM = 5.0


def _bars_per_pathogen(table: DataFrame, fill: str | None, value: str, refs: dict[str, str]) -> DataFrame:
    """Grouped bars of each pathogen against its own reference label."""
    return union_all(
        [
            grouped_bar_data(table.filter(F.col("pathogen") == p), ["pathogen"], "label", fill, value, ref)
            for p, ref in refs.items()
        ]
    )


def clean_confrontation(raw: DataFrame) -> DataFrame:
    """Labels, colony diameter less the disc, percent inhibition against the maximum of each experiment."""
    table = recode(raw, "isolate_id", STRAINS, "treatmnt")
    table = table.withColumn("diam_mm", F.col("radius_mm") * 2 - DISC_MM)
    table = drop_columns(table, ["inoc_date", "col_date", "isolate_id", "radius_mm"])
    table = move_column(table, "treatmnt", before="pathogen")
    table = inhibition_pct(table, ["pathogen", "experiment"], "diam_mm")
    table = table.withColumns(
        {"log_fdiam": log10_or_null(F.col("diam_mm")), "sqrt_fdiam": safe_sqrt(F.col("diam_mm"))}
    )
    return rename(table, {"inhibition_zone": "iz", "yeast_diameter": "ydiam_mm"})


def clean_diameter(raw: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Pathogen-on-yeast and volatile tables: labels and diameter less the disc."""
    table = recode(raw, "isolate_id", STRAINS, "treatmnt")
    table = table.withColumn("diam_mm", F.col("diam_mm") - DISC_MM)
    return move_column(drop_columns(table, [*dates, "isolate_id"]), "treatmnt", before="pathogen")


def relative_response(clean: DataFrame, by) -> DataFrame:
    """Maximum over the slice `by`, percent inhibition, log10(x + 1) and root."""
    table = window_agg(clean, by, "diam_mm", "max", "max_diam")
    d = F.col("diam_mm")
    return table.withColumns(
        {
            "perc_in": inhibition(d, F.col("max_diam")),
            "log_diam": log10_or_null(d, 1.0),
            "sqrt_diam": safe_sqrt(d),
        }
    )


def explore(table: DataFrame, by, group: str, value: str) -> dict[str, DataFrame]:
    """Summary statistics, distribution charts, outliers and assumption checks of one response."""
    by = names(by)
    cell = [*by, group]
    resid = residuals(table, by, group, value)
    return {
        "stats": summary_stats(table, cell, value),
        "box": box_data(table, cell, value),
        "histogram": hist_data(table, by, value),
        "outliers": identify_outliers(table, cell, value),
        "anova": anova_oneway(table, by, group, value),
        "qq_residuals": qq_data(resid, by, "residual"),
        "qq_std_residuals": qq_residuals(table, by, group, value),
        "shapiro_residuals": shapiro(resid, by, "residual"),
        "shapiro_groups": shapiro(table, cell, value),
        "qq_groups": qq_data(table, cell, value),
        "residual_fitted": resid_data(table, by, group, value),
        "levene": levene(table, by, group, value),
        "describe": describe(table, by, value),
    }


def post_hoc(table: DataFrame, by, group: str, value: str, method: str) -> DataFrame:
    if method == "ranksum":
        return pairwise_ranksum(table, by, group, value)
    if method == "dunn":
        return dunn(table, by, group, value)
    raise ValueError(f"unknown post-hoc method {method!r}")


def lettered_summary(
    table: DataFrame, by, group: str, value: str, method: str, null_policy: str = "propagate"
) -> DataFrame:
    """Treatment summary with compact letters of the post-hoc test, best treatment first."""
    by = names(by)
    table = table.select(*dict.fromkeys([*by, group, value]))  # read by test and summary
    letters = compact_letters(post_hoc(table, by, group, value, method), by)
    summary = treatment_summary(table, by, group, value, null_policy)
    return attach_letters(summary, letters, by, group).orderBy(*by, F.desc_nulls_last("mean"))


def assay_report(
    table: DataFrame, by, group: str, value: str, method: str, levels: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Exploration, omnibus test, pair table, lettered summary and bar chart table."""
    by = names(by)
    pairs = stage(post_hoc(table, by, group, value, method))
    letters = compact_letters(pairs, by)
    summary = attach_letters(treatment_summary(table, by, group, value), letters, by, group)
    return {
        **explore(table, by, group, value),
        "kruskal": kruskal(table, by, group, value),
        "pairs": pairs,
        "pair_table": full_pairs(pairs, by),
        "letters": letters,
        "summary": summary.orderBy(*by, F.desc_nulls_last("mean")),
        "bars": bar_data(summary, group, levels=levels, by=by),
    }


def confrontation_report(
    raw: DataFrame, pooled: bool = False, method: str = "ranksum", levels: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Confrontation assay. Pooled slices keep the maximum of each experiment."""
    table = stage(clean_confrontation(raw))
    by = ["pathogen"] if pooled else ["pathogen", "experiment"]
    report = {"clean": table, **assay_report(table, by, "treatmnt", "perc_in", method, levels)}
    points = scatter_fit_data(table, [], "iz", "perc_in")
    zones = scatter_fit_data(table.filter(F.col("iz") > 0), [], "iz", "ydiam_mm")
    report.update({f"zone_inhibition_{k}": v for k, v in points.items()})
    report.update({f"zone_yeast_{k}": v for k, v in zones.items()})
    report["zone_inhibition_r"] = pearson(table, [], "iz", "perc_in")
    return report


def diameter_report(
    raw: DataFrame,
    dates: Sequence[str] = ("inoc_date", "col_date"),
    pooled: bool = False,
    method: str = "dunn",
    levels: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Pathogen-on-yeast or volatile assay. Pooled slices take one maximum over all experiments."""
    by = ["pathogen"] if pooled else ["pathogen", "experiment"]
    table = stage(relative_response(clean_diameter(raw, dates), by))
    return {"clean": table, **assay_report(table, by, "treatmnt", "perc_in", method, levels)}


def clean_germination(raw: DataFrame) -> DataFrame:
    """Wide counts (three treatments per row) to one row per treatment."""
    table = select_positions(clean_names(raw), drop=["reps", 8, 9])
    ids = [table.columns[i - 1] for i in (1, 2, 6)]
    return to_long(table, ids, "treatmnt", "value")


def compare_rates(rates: DataFrame) -> DataFrame:
    """Rank-sum pairs of the treatments over the rates of the yeasts, per pathogen and experiment."""
    return pairwise_ranksum(rates, ["pathogen", "experiment"], "treatmnt", "rate")


def germination_report(raw: DataFrame, offset: float = 0.0, se_offset: float = 0.0) -> dict[str, DataFrame]:
    """Spore germination: rates per experiment and pooled, Kruskal and Dunn per pathogen and yeast.

    `offset` and `se_offset` are added to the rates and to the standard errors of the summary.
    """
    table = stage(clean_germination(raw))
    by, group = ["pathogen", "yeast_id"], "treatmnt"
    rates = stage(germination_rate(table, ["pathogen", "experiment", "yeast_id", group], "value", offset))
    rate_pairs = stage(compare_rates(rates))
    pairs = stage(dunn(table, by, group, "value"))
    letters = compact_letters(pairs, by)
    pooled = attach_letters(germination_rate(table, [*by, group], "value", offset, se_offset), letters, by, group)
    return {
        "clean": table,
        "rates": rates,
        "rate_bars": grouped_bar_data(rates, ["pathogen", "experiment"], "yeast_id", group, "rate", fill_ref="sdw"),
        "rate_pairs": rate_pairs,
        "rate_letters": compact_letters(rate_pairs, ["pathogen", "experiment"]),
        "kruskal": kruskal(table, by, group, "value"),
        "pairs": pairs,
        "letters": letters,
        "summary": pooled.orderBy(*by, F.desc_nulls_last("rate")),
        "bars": bar_data(pooled, group, mean="rate", levels=["sdw", "wcs", "cfs"], by=by),
    }


def screened_table(raw: DataFrame, order: str = "row_id") -> DataFrame:
    """Number of distinct screened isolates per name."""
    table = complete_on(clean_names(raw), ["isolate"])
    table = table.filter(F.col("organism") != "bacteria").filter(F.col("name") != "Control")
    return count_by(distinct_first(table, "isolate", order), "name").orderBy(F.asc_nulls_last("name"))


def prescreen_table(raw: DataFrame, pathogen: str | None = None) -> DataFrame:
    """Mean diameter per pre-screened isolate, for one pathogen or for all."""
    table = clean_names(raw).withColumn("diam_mm", F.col("radius_mm") * 2)
    table = table.filter(F.col("organism") != "bacteria")
    if pathogen is not None:
        table = table.filter(F.col("pathogen") == pathogen)
    keys = ["sample", "isolate", "name"]
    return treatment_summary(table, keys, "pathogen", "diam_mm").orderBy(F.asc_nulls_last("name"))


def clean_lesions(raw: DataFrame) -> DataFrame:
    """The analysed treatments, with the day as a factor."""
    table = raw.select("treatment", "av_ld", "pathogen", "dpi").filter(F.col("treatment").isin(FRUIT_TREATMENTS))
    return table.withColumn("dpi", F.col("dpi").cast("string"))


def lesion_report(
    raw: DataFrame, labels: dict[str, str] = FRUIT_LABELS, refs: dict[str, str] = FRUIT_REFERENCES
) -> dict[str, DataFrame]:
    """Detached-fruit lesions: factorial analysis, checks, omnibus tests by factor, pairs and chart."""
    table = stage(clean_lesions(raw))
    factors = ["treatment", "pathogen", "dpi"]
    marked = recode(table, "treatment", labels, "label")
    report = {
        "clean": table,
        "levels": as_factor(table, "treatment").select("treatment", "level_ord").distinct(),
        "anova": anova_factorial(table, [], factors, "av_ld"),
        "levene": levene(table, [], "treatment", "av_ld"),
        "residual_fitted": resid_data(table, [], factors, "av_ld"),
        "qq_std_residuals": qq_residuals(table, [], factors, "av_ld"),
        "shapiro": shapiro(residuals(table, [], factors, "av_ld"), [], "residual"),
        "describe": describe(table, [], "av_ld"),
        "pairs": pairwise_ranksum(table, [], "treatment", "av_ld"),
        "bars": _bars_per_pathogen(marked, "dpi", "av_ld", refs),
        "kruskal_treatment_within": kruskal(table, ["pathogen"], "treatment", "av_ld"),
        "kruskal_dpi_within": kruskal(table, ["pathogen"], "dpi", "av_ld"),
    }
    report.update({f"kruskal_{f}": kruskal(table, [], f, "av_ld") for f in factors})
    return report


def incidence_report(
    lesions: DataFrame, dpi: str = "7", cut: float = 1.0, labels: dict[str, str] = FRUIT_LABELS
) -> dict[str, DataFrame]:
    """Percent of fruit with a lesion, per treatment and pathogen, and the tests on that table."""
    late = lesions.filter(F.col("dpi").cast("string") == dpi)
    table = stage(incidence_pct(late, ["treatment", "pathogen"], "av_ld", cut))
    factors = ["treatment", "pathogen"]
    return {
        "flags": flag_threshold(late, "av_ld", cut, "pres_abs"),
        "incidence": table,
        "anova": anova_factorial(table, [], factors, "incidence"),
        "levene": levene(table, [], "treatment", "incidence"),
        "shapiro": shapiro(residuals(table, [], factors, "incidence"), [], "residual"),
        "kruskal_treatment": kruskal(table, [], "treatment", "incidence"),
        "kruskal_pathogen": kruskal(table, [], "pathogen", "incidence"),
        "pairs": pairwise_ranksum(table, [], "treatment", "incidence"),
        "bars": grouped_bar_data(
            recode(table, "treatment", labels, "label"), ["pathogen"], "label", None, "incidence"
        ),
    }


def severity_report(
    raw: DataFrame,
    dpi: int = 7,
    per_row: bool = False,
    labels: dict[str, str] = FRUIT_LABELS,
    refs: dict[str, str] = FRUIT_REFERENCES,
) -> dict[str, DataFrame]:
    """Severity index per treatment and pathogen, and the tests on that table.

    With `per_row` the index stands next to every rating row and the tests see
    each index as often as it has rating rows.
    """
    rows = raw.filter(F.col("dpi") == dpi)
    keys, columns = ["treatment", "dpi", "pathogen"], ("rating_scale", "total_rating")
    index = severity_window if per_row else severity_index
    table = stage(index(rows, keys, *columns))
    factors = ["treatment", "pathogen"]
    return {
        "severity": table,
        "anova": anova_factorial(table, [], factors, "dis_sev"),
        "shapiro": shapiro(residuals(table, [], factors, "dis_sev"), [], "residual"),
        "describe": describe(table, [], "dis_sev"),
        "kruskal_treatment": kruskal(table, [], "treatment", "dis_sev"),
        "kruskal_pathogen": kruskal(table, [], "pathogen", "dis_sev"),
        "pairs": pairwise_ranksum(table, [], "treatment", "dis_sev"),
        "bars": _bars_per_pathogen(recode(table, "treatment", labels, "label"), None, "dis_sev", refs),
    }


def fermentation_lines(raw: DataFrame) -> DataFrame:
    """Weight loss per strain and day, as the change from day 1."""
    days = [c for c in raw.columns if c != "strain"]
    return series_data(raw, "strain", days, "day", "weight")
