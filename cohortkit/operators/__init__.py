"""DataFrame-to-DataFrame operators.

All are lazy but ``fit_logistic``, ``grid_bounds`` and ``one_hot_grid``, which run jobs while
they are built. No rows come to the driver.
"""

from cohortkit.operators.cohort import (
    cohort,
    complete_cases,
    file_sample,
    fill_nulls,
    first_rows,
    flag_columns,
    hash_sample,
    hash_split,
    int_column,
    random_sample,
    random_split,
    rename_columns,
    tag_split,
)
from cohortkit.operators.evaluate import (
    auc,
    confusion_long,
    correlation_matrix,
    pivot_counts,
    roc_points,
)
from cohortkit.operators.grid import (
    bounding_box,
    grid_bounds,
    grid_buckets,
    grid_rate,
    highest_cells,
    one_hot_grid,
)
from cohortkit.operators.groups import (
    distinct_values,
    group_counts,
    group_share,
    mean_by,
    row_count,
    totals_by,
)
from cohortkit.operators.model import Logit, feature_table, fit_logistic, score
from cohortkit.operators.moments import wide_correlations
from cohortkit.operators.profile import (
    flag_counts,
    flag_profile,
    flag_ratios,
    null_counts,
    null_ratios,
)
from cohortkit.operators.reports import totals_by_sets

__all__ = [
    "Logit",
    "auc",
    "bounding_box",
    "cohort",
    "complete_cases",
    "confusion_long",
    "correlation_matrix",
    "distinct_values",
    "feature_table",
    "file_sample",
    "fill_nulls",
    "first_rows",
    "fit_logistic",
    "flag_columns",
    "flag_counts",
    "flag_profile",
    "flag_ratios",
    "grid_bounds",
    "grid_buckets",
    "grid_rate",
    "group_counts",
    "group_share",
    "hash_sample",
    "hash_split",
    "int_column",
    "mean_by",
    "null_counts",
    "null_ratios",
    "highest_cells",
    "one_hot_grid",
    "pivot_counts",
    "random_sample",
    "random_split",
    "rename_columns",
    "roc_points",
    "row_count",
    "score",
    "tag_split",
    "totals_by",
    "totals_by_sets",
    "wide_correlations",
]
