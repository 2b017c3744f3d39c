"""Two-dataset comparison: column overlap, numeric side-by-side statistics
and the overview of both stats records.

Name-set algebra runs on the driver over ``df.columns`` (schema only, no
job, case-sensitive like Python sets); the statistics are one aggregate per
side and a join of two small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, sql_clean_numeric
from .common import per_column
from .profile import dataset_stats


def column_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, status, dtype_1, dtype_2)``; status is common / only_in_1 /
    only_in_2, columns sorted by name within each status."""
    t1 = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    t2 = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    rows = ([(c, "common", t1[c], t2[c]) for c in sorted(set(t1) & set(t2))]
            + [(c, "only_in_1", t1[c], None) for c in sorted(set(t1) - set(t2))]
            + [(c, "only_in_2", None, t2[c]) for c in sorted(set(t2) - set(t1))])
    return a.sparkSession.createDataFrame(
        rows, "column string, status string, dtype_1 string, dtype_2 string")


def common_numeric(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns numeric on both sides, sorted by name."""
    return sorted(set(numeric_columns(a)) & set(numeric_columns(b)))


def _side(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    st = per_column(df, cols, lambda c: sql_clean_numeric(c, types[c]), {
        "mean": "avg({v})", "std": "stddev_samp({v})", "missing": "count_if({v} IS NULL)"})
    return st.select("column", F.col("mean").alias(f"mean_{k}"), F.col("std").alias(f"std_{k}"),
                     F.col("missing").cast("long").alias(f"missing_{k}"))


def compare_numeric(a: DataFrame, b: DataFrame, max_columns: int | None = None) -> DataFrame:
    """``(column, mean_1, mean_2, std_1, std_2, missing_1, missing_2)`` for
    the common numeric columns in name order, or the first ``max_columns`` of
    them. All-missing columns give null mean and std."""
    cols = common_numeric(a, b)
    cols = cols[:max_columns] if max_columns else cols
    return (_side(a, cols, 1).join(_side(b, cols, 2), "column")
            .select("column", "mean_1", "mean_2", "std_1", "std_2", "missing_1", "missing_2"))


_METRICS = ("rows", "columns", "numeric", "categorical", "missing_cells", "missing_pct",
            "duplicate_rows", "memory_kb")


def _overview_side(df: DataFrame, name: str, k: int) -> DataFrame:
    s = dataset_stats(df, name).select(
        F.col("rows").cast("double").alias("rows"), F.col("columns").cast("double").alias("columns"),
        F.size("numeric_columns").cast("double").alias("numeric"),
        F.size("categorical_columns").cast("double").alias("categorical"),
        F.col("missing_cells").cast("double").alias("missing_cells"),
        F.col("missing_pct").cast("double").alias("missing_pct"),
        F.col("duplicate_rows").cast("double").alias("duplicate_rows"),
        F.col("memory_kb").cast("double").alias("memory_kb"))
    return s.unpivot([], list(_METRICS), "metric", f"value_{k}")


def compare_overview(a: DataFrame, b: DataFrame, name_1: str = "", name_2: str = "") -> DataFrame:
    """``(metric, value_1, value_2)`` for the eight overview metrics."""
    return _overview_side(a, name_1, 1).join(_overview_side(b, name_2, 2), "metric")
