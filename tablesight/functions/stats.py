"""Statistic expressions with pandas-compatible definitions.

Spark's ``skewness``/``kurtosis`` are population moments; pandas and most
report tools show the sample-adjusted forms, derived here from Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col


def adjusted_skewness(x: Column) -> Column:
    """Sample-adjusted skewness G1 = g1 * sqrt(n(n-1)) / (n-2); null for n < 3
    and for constant columns."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Sample-adjusted excess kurtosis
    G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); null for n < 4 and constants."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null (not an
    error) when either side is constant. Inputs must already be NaN-free."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    den = F.stddev_samp(xx) * F.stddev_samp(yy)
    return F.when(den > 0, F.covar_samp(xx, yy) / den)


def round_half_up(x: Column, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain IEEE arithmetic, so any engine
    computing the same double gets the same rounded double (decimal-based
    rounding differs between engines on binary ties such as 154.31375).
    Doubles beyond 2^52 are integers already and are kept."""
    t = x.cast("double") * float(10 ** digits) + 0.5
    return F.when(F.abs(t) < 4.0e15, F.floor(t).cast("double")).otherwise(t - 0.5) / float(10 ** digits)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every top-level float/double column with ``round_half_up``."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_half_up(c, digits)
        out.append(c.alias(f.name))
    return df.select(out)


# Bytes per cell of fixed-width types in the logical size
# (our engine-independent definition of "memory", not a JVM measurement).
LOGICAL_WIDTH = {
    "boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8,
    "float": 4, "double": 8, "decimal": 16, "date": 4, "timestamp": 8,
    "timestamp_ntz": 8, "interval": 8,
}


def logical_width(dt: T.DataType) -> int | None:
    """Fixed width in bytes, or None for variable-width types."""
    if isinstance(dt, T.DecimalType):
        return LOGICAL_WIDTH["decimal"]
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return LOGICAL_WIDTH["interval"]
    return LOGICAL_WIDTH.get(dt.typeName())


# SQL templates over {v} for the per-column helper.
SKEWNESS_SQL = ("CASE WHEN count({v}) >= 3 THEN skewness({v}) * sqrt(CAST(count({v}) AS DOUBLE) * (count({v}) - 1))"
                " / (count({v}) - 2) END")
KURTOSIS_SQL = ("CASE WHEN count({v}) >= 4 THEN (count({v}) - 1) / (CAST(count({v}) - 2 AS DOUBLE) * (count({v}) - 3))"
                " * ((count({v}) + 1) * kurtosis({v}) + 6) END")


def corr_sql(x: str, y: str) -> str:
    """Pairwise-complete Pearson correlation as SQL; null for constants."""
    xx = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    yy = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    den = f"(stddev_samp({xx}) * stddev_samp({yy}))"
    return f"CASE WHEN {den} > 0 THEN covar_samp({xx}, {yy}) / {den} END"
