"""The profile report (minimal mode): overview, per-variable statistics,
quantiles, moments, MAD, common and extreme values, histograms, datetime
ranges and alerts.

Frequencies come from grouped hashes (``frequencies.value_hashes``); top-k
per column uses ``row_number() <= k`` over the grouped table, which Spark
plans with a partial WindowGroupLimit before the shuffle, so a column with
billions of distinct values never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    categorical_columns, classify, datetime_columns, from_epoch_micros, numeric_columns, sql_as_text,
    sql_clean_numeric, sql_epoch_micros, sql_is_missing,
)
from ..functions.stats import KURTOSIS_SQL, SKEWNESS_SQL
from .charts import histograms
from .common import column_names, per_column, unpivot
from .frequencies import top_values, value_hashes
from .profile import dataset_stats, duplicate_count
from .quantiles import quantiles
from ..session import bounded

REPORT_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _num(df: DataFrame):
    types = {f.name: f.dataType for f in df.schema.fields}
    return numeric_columns(df), (lambda c: sql_clean_numeric(c, types[c]))


def report_overview(df: DataFrame) -> DataFrame:
    """One row: variables, observations, missing cells and %, duplicate rows
    and %, total size, average record size and the count per variable type."""
    cls = classify(df)
    s = dataset_stats(df)
    return s.select(
        F.col("columns").alias("variables"), F.col("rows").alias("observations"),
        "missing_cells", "missing_pct", "duplicate_rows",
        F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), F.lit(0.0)).alias("duplicate_pct"),
        F.col("memory_kb").alias("total_size_kb"),
        F.try_divide(F.col("memory_kb") * 1024.0, F.col("rows")).alias("avg_record_bytes"),
        *[F.lit(len(cls.get(k, []))).alias(f"n_{k}") for k in
          ("numeric", "text", "boolean", "datetime", "nested", "interval")])


def report_variables(df: DataFrame, exact: bool = True, freqs: DataFrame | None = None) -> DataFrame:
    """``(ordinal, column, distinct, distinct_pct, missing, missing_pct)``;
    distinct % is over present values, missing % over rows. ``exact=False``
    uses ``approx_count_distinct`` (one scan, no shuffle of values)."""
    if not exact:
        types = {f.name: f.dataType for f in df.schema.fields}
        val = lambda c: (f"named_struct('m', {sql_is_missing(c, types[c])}, "  # noqa: E731
                         f"'v', {sql_as_text(c, types[c])})")
        st = per_column(df, df.columns, val, {"distinct": "approx_count_distinct(CASE WHEN NOT {v}.m THEN {v}.v END)",
                                             "missing": "count_if({v}.m)", "rows": "count(1)"})
    else:
        vf = freqs if freqs is not None else value_hashes(df)
        st = vf.groupBy("ordinal").agg(
            F.count("h1").alias("distinct"),
            F.sum(F.when(F.col("h1").isNull(), F.col("n")).otherwise(0)).alias("missing"),
            F.sum("n").alias("rows")).join(F.broadcast(column_names(df, df.columns)), "ordinal")
    return st.select(
        "ordinal", "column", F.col("distinct").cast("long").alias("distinct"),
        F.try_divide(F.col("distinct") * 100.0, F.col("rows") - F.col("missing")).alias("distinct_pct"),
        F.col("missing").cast("long").alias("missing"),
        F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct"))


def report_numeric(df: DataFrame) -> DataFrame:
    """``(ordinal, column, infinite, infinite_pct, zeros, zeros_pct,
    negative, negative_pct, min, max, mean, sum)``; % over rows."""
    cols, val = _num(df)
    st = per_column(df, cols, val, {
        "rows": "count(1)", "infinite": "count_if(abs({v}) = double('inf'))",
        "zeros": "count_if({v} = 0)", "negative": "count_if({v} < 0)",
        "min": "min({v})", "max": "max({v})", "mean": "avg({v})", "sum": "sum({v})"})
    pct = lambda c: F.try_divide(F.col(c) * 100.0, F.col("rows")).alias(f"{c}_pct")
    return st.select("ordinal", "column",
                     F.col("infinite").cast("long").alias("infinite"), pct("infinite"),
                     F.col("zeros").cast("long").alias("zeros"), pct("zeros"),
                     F.col("negative").cast("long").alias("negative"), pct("negative"),
                     "min", "max", "mean", "sum")


def report_quantiles(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(ordinal, column, p5, p25, p50, p75, p95, range, iqr)``."""
    cols, val = _num(df)
    mm = per_column(df, cols, val, {"min": "min({v})", "max": "max({v})"})
    q = quantiles(unpivot(df, cols, val, names=False), REPORT_QUANTILES, keys=["ordinal"], exact=exact)
    names = ["p5", "p25", "p50", "p75", "p95"]
    return (mm.join(q, "ordinal", "left")
              .select("ordinal", "column", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)],
                      (F.col("max") - F.col("min")).alias("range"),
                      (F.col("quantiles")[3] - F.col("quantiles")[1]).alias("iqr")))


def report_moments(df: DataFrame) -> DataFrame:
    """``(ordinal, column, mean, std, variance, cv, skewness, kurtosis)`` —
    sample std/variance, cv = std/mean, sample-adjusted skewness and excess
    kurtosis."""
    cols, val = _num(df)
    st = per_column(df, cols, val, {
        "mean": "avg({v})", "std": "stddev_samp({v})", "variance": "var_samp({v})",
        "skewness": SKEWNESS_SQL, "kurtosis": KURTOSIS_SQL})
    return st.select("ordinal", "column", "mean", "std", "variance",
                     F.try_divide(F.col("std"), F.col("mean")).alias("cv"), "skewness", "kurtosis")


def report_mad(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(ordinal, column, median, mad)``: median absolute deviation from the
    median, the quantile of the values and then of their deviations. Only the
    medians, one per column, come to the driver; no value table is written."""
    cols, val = _num(df)
    names = F.broadcast(column_names(df, cols))
    long = unpivot(df, cols, val, names=False)
    med = bounded(quantiles(long, [0.5], keys=["ordinal"], exact=exact).select(
        "ordinal", F.col("quantiles")[0].alias("median")), len(cols))
    # one median per column: a bounded summary, inlined as literals (no join)
    m = {r["ordinal"]: r["median"] for r in med.collect()}
    case = " ".join(f"WHEN {o} THEN CAST('{v!r}' AS DOUBLE)" for o, v in m.items() if v is not None)
    centre = f"(CASE ordinal {case} END)" if case else "CAST(NULL AS DOUBLE)"
    mad = quantiles(long.selectExpr("ordinal", f"abs(value - {centre}) AS value"), [0.5], keys=["ordinal"], exact=exact)
    mad = mad.select("ordinal", F.col("quantiles")[0].alias("mad"))
    return (names.join(med, "ordinal", "left").join(mad, "ordinal", "left")
                 .select("ordinal", "column", "median", "mad"))


def top_per_column(freqs: DataFrame, k: int, ascending_value: bool = False, by_value: bool = False,
                   value: str = "value") -> DataFrame:
    """Keep the ``k`` first rows per column: most frequent (ties by value),
    or smallest / largest values when ``by_value``."""
    if by_value:
        order = [F.col(value).asc() if ascending_value else F.col(value).desc()]
    else:
        order = [F.col("n").desc(), F.col(value).asc()]
    w = Window.partitionBy("ordinal", "column").orderBy(*order)
    return freqs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def report_common_values(df: DataFrame, k: int = 10, freqs: DataFrame | None = None) -> DataFrame:
    """``(ordinal, column, rank, value, count, pct)``: the ``k`` most common
    present values per column; % over rows."""
    vf = freqs if freqs is not None else value_hashes(df)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    top = top_values(df, vf, k).join(F.broadcast(column_names(df, df.columns)), "ordinal")
    return (top.crossJoin(F.broadcast(rows))
               .select("ordinal", "column", "rank", "value", F.col("n").cast("long").alias("count"),
                       F.try_divide(F.col("n") * 100.0, F.col("_rows")).alias("pct")))


def report_extremes(df: DataFrame, k: int = 5) -> DataFrame:
    """``(ordinal, column, side, rank, value, count)``: the ``k`` smallest
    (side 'min') and largest (side 'max') distinct values per numeric column."""
    cols, val = _num(df)
    vc = (unpivot(df, cols, val, names=False).filter(F.col("value").isNotNull())
              .groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.lit(None)))
    lo = top_per_column(vc, k, ascending_value=True, by_value=True).withColumn("side", F.lit("min"))
    hi = top_per_column(vc, k, ascending_value=False, by_value=True).withColumn("side", F.lit("max"))
    return (lo.unionByName(hi).drop("column").join(F.broadcast(column_names(df, cols)), "ordinal")
              .select("ordinal", "column", "side", "rank", "value", F.col("n").cast("long").alias("count")))


def report_histograms(df: DataFrame, bins: int = 30) -> DataFrame:
    return histograms(df, bins=bins)


def report_datetime(df: DataFrame) -> DataFrame:
    """``(ordinal, column, min, max, range_micros)`` per datetime column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    st = per_column(df, datetime_columns(df), lambda c: sql_epoch_micros(c, types[c]),
                    {"min": "min({v})", "max": "max({v})"})
    return st.select("ordinal", "column", from_epoch_micros(F.col("min")).alias("min"),
                     from_epoch_micros(F.col("max")).alias("max"),
                     (F.col("max") - F.col("min")).cast("long").alias("range_micros"))


# Default alert thresholds (as documented for the minimal
# profile: skewness above 20, more than 50 categories, zeros above 10 %).
ALERTS = {"skewness": 20.0, "cardinality": 50, "zeros_pct": 10.0, "missing_pct": 0.0}


def report_alerts(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """``(column, alert, value)``: constant, unique, missing, zeros, infinite,
    skewed, high_cardinality per column, and duplicates for the table ('*')."""
    th = dict(ALERTS, **(thresholds or {}))
    var = report_variables(df)
    cat = set(categorical_columns(df))
    a = [var.filter("distinct = 1").select("column", F.lit("constant").alias("alert"),
                                          F.col("distinct").cast("double").alias("value")),
         var.filter("distinct > 1 and distinct_pct = 100").select(
             "column", F.lit("unique").alias("alert"), F.col("distinct_pct").alias("value")),
         var.filter(F.col("missing_pct") > th["missing_pct"]).select(
             "column", F.lit("missing").alias("alert"), F.col("missing_pct").alias("value")),
         var.filter(F.col("column").isin(list(cat)) & (F.col("distinct") > th["cardinality"])).select(
             "column", F.lit("high_cardinality").alias("alert"), F.col("distinct").cast("double").alias("value"))]
    if numeric_columns(df):
        # zeros, infinite values and skewness of all numeric columns in one pass
        cols, val = _num(df)
        st = per_column(df, cols, val, {
            "rows": "count(1)", "zeros": "count_if({v} = 0)", "infinite": "count_if(abs({v}) = double('inf'))",
            "skewness": SKEWNESS_SQL})
        pct = lambda c: F.try_divide(F.col(c) * 100.0, F.col("rows"))
        a += [st.filter(pct("zeros") > th["zeros_pct"]).select(
                  "column", F.lit("zeros").alias("alert"), pct("zeros").alias("value")),
              st.filter("infinite > 0").select("column", F.lit("infinite").alias("alert"),
                                               pct("infinite").alias("value")),
              st.filter(F.abs("skewness") > th["skewness"]).select(
                  "column", F.lit("skewed").alias("alert"), F.col("skewness").alias("value"))]
    dup = duplicate_count(df).filter("duplicate_rows > 0").select(
        F.lit("*").alias("column"), F.lit("duplicates").alias("alert"),
        F.col("duplicate_rows").cast("double").alias("value"))
    out = dup
    for p in a:
        out = out.unionByName(p)
    return out
