"""Readers (CSV, Excel, JSON, Parquet) and sinks."""

from .readers import (  # noqa: F401
    NA_TOKENS, SUPPORTED, format_label, infer_types, normalize_missing, read_csv, read_dataset,
    read_excel, read_json, read_parquet, type_decisions,
)
from .workbooks import read_workbooks  # noqa: F401
