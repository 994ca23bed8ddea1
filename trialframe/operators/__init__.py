from .chartdata import (
    bar_data,
    box_data,
    grouped_bar_data,
    hist_data,
    qq_data,
    qq_residuals,
    resid_data,
    scatter_fit_data,
    series_data,
)
from .clean import (
    as_factor,
    clean_names,
    complete_on,
    count_by,
    derive,
    distinct_first,
    drop_columns,
    flag_threshold,
    keep_columns,
    level_medians,
    move_column,
    recode,
    recode_from,
    rename,
    reorder_levels,
    select_positions,
    to_long,
    with_level_order,
)
from .compare import compare_means, omnibus, stars_vs_reference
from .linear import (
    anova_factorial,
    anova_first_and_residual,
    anova_oneway,
    fit_band,
    levene,
    ols_line,
    pearson,
    residuals,
)
from .multiple import (
    adjust_bh,
    attach_letters,
    compact_letters,
    full_pairs,
    group_pairs,
    pair_matrix,
    vs_reference,
)
from .ordering import midrank, order_index, quantiles
from .ranktests import dunn, kruskal, pairwise_ranksum
from .response import (
    baseline_delta,
    baseline_delta_long,
    inhibition_pct,
    inhibition_summary,
    series_change,
    severity_window,
    transforms,
    window_agg,
)
from .shape import describe, identify_outliers, shape_stats, shapiro, shapiro_residuals
from .slices import slice_by
from .summarise import (
    germination_rate,
    incidence_pct,
    mean_se,
    severity_index,
    sliced_and_pooled,
    summary_stats,
    treatment_summary,
)

__all__ = [name for name in dir() if not name.startswith("_")]
