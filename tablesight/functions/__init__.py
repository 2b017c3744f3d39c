"""Column-level building blocks shared by all operators."""

from .columns import (  # noqa: F401
    col, classify, column_class, is_numeric, is_float, is_datetime, is_interval,
    numeric_columns, non_numeric_columns, categorical_columns, datetime_columns,
    is_missing, clean_numeric, comparable, as_text, epoch_micros, from_epoch_micros,
)
from .stats import (  # noqa: F401
    adjusted_skewness, adjusted_kurtosis, safe_corr, round_doubles, logical_width,
)
