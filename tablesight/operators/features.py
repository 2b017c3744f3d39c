"""Feature construction: ratios, log1p, date parts, bins, frequency
encoding, missing flags, group-relative values, and the candidate list.

Per-key statistics (frequencies, group means) are grouped with partial
aggregation and joined back, so a key holding a third of the rows is one
partial row per task; AQE splits the skewed side of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    categorical_columns, clean_numeric, col, datetime_columns, is_missing, numeric_columns, sql_clean_numeric,
)
from .charts import _bin
from .quantiles import quantiles
from .common import join_back, q, unpivot


def ratio(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """Add ``a / b`` as double; null where b is 0 or missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn(name or f"{a}_per_{b}",
                         F.try_divide(clean_numeric(a, types[a]), clean_numeric(b, types[b])))


def log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``log1p_<c>``; null for negative values (log1p is for counts and
    amounts)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for c in cols:
        v = clean_numeric(c, types[c])
        out = out.withColumn(f"log1p_{c}", F.when(v >= 0, F.log1p(v)))
    return out


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add ``<ts>_year``, ``_month``, ``_dow`` (Monday = 0) and ``_hour``."""
    c = col(ts)
    return (df.withColumn(f"{ts}_year", F.year(c)).withColumn(f"{ts}_month", F.month(c))
              .withColumn(f"{ts}_dow", F.weekday(c)).withColumn(f"{ts}_hour", F.hour(c)))


def bins(df: DataFrame, column: str, k: int = 10, method: str = "width", exact: bool = True) -> DataFrame:
    """Add ``<column>_bin`` (0..k-1). ``width``: equal-width over [min, max]
    (last bin closed). ``quantile``: cut at the k-quantiles (a value equal to
    a cut goes to the upper bin), exact or approximate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    v = clean_numeric(column, types[column])
    if method == "width":
        rng = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        return (df.crossJoin(F.broadcast(rng))
                  .withColumn(f"{column}_bin", _bin(v, F.col("_lo"), F.col("_hi"), k))
                  .drop("_lo", "_hi"))
    probs = [i / k for i in range(1, k)]
    cuts = quantiles(unpivot(df, [column], lambda c: sql_clean_numeric(c, types[c]), names=False), probs,
                     keys=["ordinal"], exact=exact).select(
        F.col("quantiles").alias("_cuts"))
    idx = F.size(F.filter(F.col("_cuts"), lambda x: x <= v))
    return (df.crossJoin(F.broadcast(cuts))
              .withColumn(f"{column}_bin", F.when(v.isNotNull(), idx)).drop("_cuts"))


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_freq``: how many rows share the value (missing -> 0)."""
    dt = df.schema[column].dataType
    key = F.when(~is_missing(column, dt), col(column))
    counts = (df.select(key.alias("_k")).filter(F.col("_k").isNotNull())
                .groupBy("_k").agg(F.count(F.lit(1)).alias(f"{column}_freq")))
    out = join_back(df.withColumn("_k", key), counts, ["_k"]).drop("_k")
    return out.withColumn(f"{column}_freq", F.coalesce(F.col(f"{column}_freq"), F.lit(0)))


def missing_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``<c>_missing`` (1 if null/NaN, else 0)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else df.columns
    return df.select("*", *[is_missing(c, types[c]).cast("int").alias(f"{c}_missing") for c in cols])


def group_relative(df: DataFrame, group: str, x: str) -> DataFrame:
    """Add ``<x>_minus_<group>_mean``: x minus the mean of x in its group
    (groups include the missing key, like SQL)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    v = clean_numeric(x, types[x])
    means = df.groupBy(col(group).alias(group)).agg(F.avg(v).alias("_m"))
    out = join_back(df, means, [group])
    return out.withColumn(f"{x}_minus_{group}_mean", v - F.col("_m")).drop("_m")


def feature_candidates(df: DataFrame, skew: float = 1.0, max_groups: int = 50,
                       high_cardinality: int = 50) -> DataFrame:
    """``(feature, expression, reason)``: rules over one statistics pass.

    - log1p for numeric columns with min >= 0 and |adjusted skewness| > skew;
    - ratio a/b for numeric pairs (schema order) whose denominator min > 0;
    - date parts for every datetime column;
    - frequency encoding for text columns with more than ``high_cardinality``
      values;
    - a missing flag for every column with missing values;
    - each numeric column relative to its mean in the groups of each text
      column with at most ``max_groups`` values.
    Expressions are Spark SQL usable in ``selectExpr``.
    """
    from ..functions.stats import SKEWNESS_SQL
    from .common import per_column
    from .report import report_variables
    types = {f.name: f.dataType for f in df.schema.fields}
    num = numeric_columns(df)
    st = per_column(df, num, lambda c: sql_clean_numeric(c, types[c]),
                    {"mn": "min({v})", "sk": SKEWNESS_SQL}) if num else None
    var = report_variables(df)

    def quoted(name: str) -> Column:
        return F.concat(F.lit("`"), F.replace(F.col(name), F.lit("`"), F.lit("``")), F.lit("`"))

    rows = []
    if st is not None:
        pos = {c: i for i, c in enumerate(num)}
        s = st.select("column", "mn", "sk")
        rows.append(s.filter((F.col("mn") >= 0) & (F.abs("sk") > skew)).select(
            F.concat(F.lit("log1p_"), "column").alias("feature"),
            F.concat(F.lit("log1p("), quoted("column"), F.lit(")")).alias("expression"),
            F.lit("skewed non-negative").alias("reason")))
        pairs = df.sparkSession.createDataFrame(
            [(a, b) for a in num for b in num if pos[a] < pos[b]], "a string, b string")
        dens = s.filter(F.col("mn") > 0).select(F.col("column").alias("b"))
        rows.append(pairs.join(dens, "b").select(
            F.concat("a", F.lit("_per_"), "b").alias("feature"),
            F.concat(F.lit("try_divide("), quoted("a"), F.lit(", "), quoted("b"), F.lit(")")).alias("expression"),
            F.lit("ratio, positive denominator").alias("reason")))
    dparts = [(f"{c}_{p}", f"{fn}({q(c)})", "date part") for c in datetime_columns(df)
              for p, fn in (("year", "year"), ("month", "month"), ("dow", "weekday"), ("hour", "hour"))]
    text = [c for c in categorical_columns(df) if c in types and types[c].typeName() == "string"]
    lit_rows = df.sparkSession.createDataFrame(dparts, "feature string, expression string, reason string")
    rows.append(lit_rows)
    v = var.select("column", "distinct", "missing")
    rows.append(v.filter(F.col("column").isin(text) & (F.col("distinct") > high_cardinality)).select(
        F.concat("column", F.lit("_freq")).alias("feature"),
        F.concat(F.lit("count("), quoted("column"), F.lit(") over (partition by "), quoted("column"), F.lit(")")).alias("expression"),
        F.lit("high cardinality").alias("reason")))
    floats = [c for c in num if types[c].typeName() in ("float", "double")]
    nan = F.when(F.col("column").isin(floats), F.concat(F.lit(" or isnan("), quoted("column"), F.lit(")"))).otherwise(F.lit(""))
    rows.append(v.filter("missing > 0").select(
        F.concat("column", F.lit("_missing")).alias("feature"),
        F.concat(F.lit("cast(isnull("), quoted("column"), F.lit(")"), nan, F.lit(" as int)")).alias("expression"),
        F.lit("has missing values").alias("reason")))
    for x in num:
        rows.append(v.filter(F.col("column").isin(text) & (F.col("distinct") <= max_groups)
                             & (F.col("distinct") > 1)).select(
            F.concat(F.lit(f"{x}_minus_"), "column", F.lit("_mean")).alias("feature"),
            F.concat(F.lit(f"{q(x)} - avg({q(x)}) over (partition by "), quoted("column"), F.lit(")")).alias("expression"),
            F.lit("group-relative").alias("reason")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
