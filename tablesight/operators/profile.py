"""Dataset and column statistics (stats record, missing values, duplicates,
size, info, describe, head, value counts).

All statistics of one kind come from one job over the table; results are
small long tables keyed by column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    categorical_columns, col, column_class, comparable, datetime_columns, from_epoch_micros, is_missing,
    non_numeric_columns, numeric_columns, sql_as_text, sql_clean_numeric, sql_col, sql_epoch_micros,
    sql_is_missing,
)
from ..functions.stats import logical_width
from .common import column_names, per_column, unpivot
from .frequencies import top_values, value_hashes
from .quantiles import quantiles

QUARTILES = (0.25, 0.5, 0.75)


# ---------------------------------------------------------------- schema

def select_numeric(df: DataFrame) -> DataFrame:
    return df.select([col(c) for c in numeric_columns(df)])


def select_non_numeric(df: DataFrame) -> DataFrame:
    return df.select([col(c) for c in non_numeric_columns(df)])


def schema_table(df: DataFrame) -> DataFrame:
    """``(ordinal, column, dtype, class)``; no job, built from the schema."""
    rows = [(i, f.name, f.dataType.simpleString(), column_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, dtype string, class string")


# ---------------------------------------------------------------- missing values

def missing_counts(df: DataFrame) -> DataFrame:
    """``(ordinal, column, missing)`` for every column, one scan."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = per_column(df, df.columns, lambda c: sql_is_missing(c, types[c]), {"missing": "count_if({v})"})
    return out.select("ordinal", "column", F.col("missing").cast("long").alias("missing"))


def missing_only(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value (the reference's profile section)."""
    return missing_counts(df).filter("missing > 0")


def missing_sorted(df: DataFrame) -> DataFrame:
    """Missing counts, most first, ties by column name."""
    return missing_counts(df).orderBy(F.desc("missing"), "column")


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows missing (null or NaN) in ``cols``."""
    return df.na.drop(how=how, subset=list(cols))


# ---------------------------------------------------------------- duplicates (A5)

def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row ``duplicate_rows``: rows beyond the first of each group of equal
    rows; missing values equal each other (pandas ``duplicated``).

    Rows are grouped by two independent 64-bit hashes of all cells and of
    which cells are missing: one scan, map-side combined, 24 bytes per group
    and task, so a row repeated a million times is one partial row per task.
    Different rows are taken as equal with a chance of 2 ** -128 per pair.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or df.columns)
    keys = [comparable(c, types[c]).alias(f"_k{i}") for i, c in enumerate(cols)]
    if not keys:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicate_rows"))
    h1, h2 = _row_hashes([f"_k{i}" for i in range(len(cols))])
    groups = df.select(*keys).groupBy(h1, h2).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _row_hashes(cols: Sequence[str]) -> tuple[Column, Column]:
    # The hash skips nulls, so which cells are missing is hashed as well.
    cells = [x for c in cols for x in (col(c), col(c).isNull())]
    return F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("_h2")


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The repeated rows themselves with their multiplicity ``copies``. Counts
    are made on row hashes; only rows of repeated hashes are grouped whole."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or df.columns)
    if any(isinstance(types[c], T.MapType) for c in cols):
        raise ValueError("duplicate_groups: map columns cannot be grouped; use duplicate_count")
    keyed = df.select(*[col(c) for c in cols], *[comparable(c, types[c]).alias(f"_k{i}") for i, c in enumerate(cols)])
    h1, h2 = _row_hashes([f"_k{i}" for i in range(len(cols))])
    hashed = keyed.select(*[col(c) for c in cols], h1, h2)
    repeated = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h1", "_h2")
    cand = hashed.join(repeated, ["_h1", "_h2"], "left_semi").select(*[col(c) for c in cols])
    return (cand.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("copies"))
                .filter("copies > 1"))


# ---------------------------------------------------------------- size

def _size_sql(name: str, dt: T.DataType) -> str:
    c = sql_col(name)
    if isinstance(dt, T.StringType):
        return f"coalesce(octet_length({c}), 0)"
    if isinstance(dt, T.BinaryType):
        return f"coalesce(length({c}), 0)"
    if isinstance(dt, T.ArrayType) and logical_width(dt.elementType) is not None:
        return f"coalesce(size({c}) * {logical_width(dt.elementType)}, 0)"
    return f"coalesce(octet_length(to_json({c})), 0)"


def _size_total(df: DataFrame) -> Column:
    fixed = sum(logical_width(f.dataType) or 0 for f in df.schema.fields)
    var = [f"coalesce(sum(CAST({_size_sql(f.name, f.dataType)} AS BIGINT)), 0)" for f in df.schema.fields
           if logical_width(f.dataType) is None]
    return F.expr("CAST(" + " + ".join([f"count(1) * {fixed}"] + var) + " AS BIGINT)")


def logical_size(df: DataFrame) -> DataFrame:
    """One row ``(bytes, memory_kb)``: fixed width per type, UTF-8 bytes for
    strings, element width times length for arrays, JSON bytes for the rest."""
    return (df.agg(_size_total(df).alias("bytes"))
              .select("bytes", F.round(F.col("bytes") / 1024, 1).alias("memory_kb")))


# ---------------------------------------------------------------- stats record

def dataset_stats(df: DataFrame, name: str = "") -> DataFrame:
    """The stats record: one row with name, rows, columns, the column lists,
    missing cells and %, duplicate rows and logical size in KB.

    One scan for counts, missing cells and size; one for duplicates.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    ncols = len(df.columns)
    miss = F.expr("CAST(" + " + ".join(["0"] + [f"count_if({sql_is_missing(c, types[c])})" for c in df.columns])
                  + " AS BIGINT)")
    base = df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("missing_cells"),
                  _size_total(df).alias("_bytes"))
    dup = duplicate_count(df)
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return (base.crossJoin(F.broadcast(dup))
                .select(F.lit(name).alias("filename"),
                        F.col("rows"),
                        F.lit(ncols).alias("columns"),
                        arr(df.columns).alias("columns_list"),
                        arr(numeric_columns(df)).alias("numeric_columns"),
                        arr(non_numeric_columns(df)).alias("categorical_columns"),
                        F.col("missing_cells"),
                        F.round(F.coalesce(F.try_divide(F.col("missing_cells") * 100.0,
                                                        F.col("rows") * F.lit(ncols)),
                                           F.lit(0.0)), 2).alias("missing_pct"),
                        F.col("duplicate_rows"),
                        F.round(F.col("_bytes") / 1024, 1).alias("memory_kb")))


def load_status(df: DataFrame, name: str = "") -> DataFrame:
    """``(dataset_loaded, filename, rows, columns)`` — the status call's view."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(True).alias("dataset_loaded"), F.lit(name).alias("filename"),
        "rows", F.lit(len(df.columns)).alias("columns"))


# ---------------------------------------------------------------- info

def info(df: DataFrame) -> DataFrame:
    """``(ordinal, column, non_null, dtype)`` like ``DataFrame.info``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    stats = per_column(df, df.columns, lambda c: sql_is_missing(c, types[c]),
                       {"missing": "count_if({v})", "rows": "count(1)"})
    return stats.join(F.broadcast(schema_table(df)), ["ordinal", "column"]).select(
        "ordinal", "column", (F.col("rows") - F.col("missing")).cast("long").alias("non_null"), "dtype")


def info_summary(df: DataFrame) -> DataFrame:
    """Totals of ``info``: columns per dtype plus rows and size."""
    st = schema_table(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))
    tot = logical_size(df).crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))
    return st.crossJoin(F.broadcast(tot))


# ---------------------------------------------------------------- describe

def describe_numeric(df: DataFrame, exact: bool = True, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, count, mean, std, min, p25, p50, p75, max)``.

    Missing (null, NaN) skipped; std is the sample std. ``exact=False`` uses
    ``approx_percentile`` for the quartiles (one scan in total).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else numeric_columns(df)
    val = lambda c: sql_clean_numeric(c, types[c])
    moments = per_column(df, cols, val, {"count": "count({v})", "mean": "avg({v})", "std": "stddev_samp({v})",
                                         "min": "min({v})", "max": "max({v})"})
    q = quantiles(unpivot(df, cols, val, names=False), QUARTILES, keys=["ordinal"], exact=exact)
    return (moments.join(q, "ordinal", "left")
                   .select("ordinal", "column", F.col("count").cast("long").alias("count"),
                           "mean", "std", "min",
                           F.col("quantiles")[0].alias("p25"), F.col("quantiles")[1].alias("p50"),
                           F.col("quantiles")[2].alias("p75"), "max"))


def value_frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, value, n)``: every distinct value (as text, null
    for missing) of every column with its count — the shared grouped table
    behind describe, distinct counts, common and extreme values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else df.columns

    def text(c: str) -> str:
        return f"CASE WHEN NOT {sql_is_missing(c, types[c])} THEN {sql_as_text(c, types[c])} END"

    counts = unpivot(df, cols, text, names=False).groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(column_names(df, cols)), "ordinal").select("ordinal", "column", "value", "n")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None,
                         freqs: DataFrame | None = None) -> DataFrame:
    """``(ordinal, column, count, unique, top, freq)``; ties for top go to the
    smallest value. Counts come from grouped hashes (``value_hashes``, also as
    ``freqs``); only the top values' texts are fetched."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    freqs = freqs if freqs is not None else value_hashes(df, cols)
    counts = freqs.filter(F.col("h1").isNotNull()).groupBy("ordinal").agg(
        F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"))
    top = top_values(df, freqs, 1, cols).select("ordinal", F.col("value").alias("top"), F.col("n").cast("long").alias("freq"))
    names = column_names(df, [c for c in df.columns if c in cols])
    return (F.broadcast(names).join(counts, "ordinal", "left").join(top, "ordinal", "left")
            .select("ordinal", "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "top", "freq"))


def describe_datetime(df: DataFrame, exact: bool = True, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, count, mean, min, p25, p50, p75, max)`` as
    zone-less timestamps. Computed on epoch microseconds; the mean is an
    exact integer sum divided by the count (floored to a microsecond)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else datetime_columns(df)
    um = lambda c: sql_epoch_micros(c, types[c])
    # exact mean: integer sum in decimal(38, 0), floored by integer division
    mom = per_column(df, cols, um, {"count": "count({v})", "min": "min({v})", "max": "max({v})",
                                    "mean": "sum(CAST({v} AS DECIMAL(38, 0))) div count({v})"})
    long = unpivot(df, cols, um, names=False)
    q = quantiles(long, QUARTILES, keys=["ordinal"], exact=exact)
    ts = lambda c: from_epoch_micros(F.floor(c))
    return (mom.join(q, "ordinal", "left")
               .select("ordinal", "column", F.col("count").cast("long").alias("count"),
                       ts(F.col("mean")).alias("mean"), ts(F.col("min")).alias("min"),
                       ts(F.col("quantiles")[0]).alias("p25"), ts(F.col("quantiles")[1]).alias("p50"),
                       ts(F.col("quantiles")[2]).alias("p75"), ts(F.col("max")).alias("max")))


def describe_interval(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, count, missing, min, max)`` for interval columns
    (their own class: no mean or quantiles); min and max as interval text."""
    from ..functions.columns import is_interval
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if is_interval(f.dataType)]
    st = per_column(df, cols, sql_col, {"count": "count({v})", "missing": "count_if({v} IS NULL)",
                                        "min": "CAST(min({v}) AS STRING)", "max": "CAST(max({v}) AS STRING)"})
    return st.select("ordinal", "column", F.col("count").cast("long").alias("count"),
                     F.col("missing").cast("long").alias("missing"), "min", "max")


def describe(df: DataFrame, exact: bool = True) -> DataFrame:
    """Combined long table (``describe(include='all')``), one row per column;
    statistics that do not apply are null. Datetime statistics are text
    (``yyyy-MM-dd HH:mm:ss.ffffff``) in the ``*_ts`` columns.

    Exact: one scan, everything derived from the shared distinct-value table
    (``shared.describe_shared``). Approximate: sketches per column class."""
    if exact:
        from .shared import describe_shared
        return describe_shared(df)
    num = describe_numeric(df, exact=exact)
    cat = describe_categorical(df)
    dtm = describe_datetime(df, exact=exact)
    dtm = dtm.select("ordinal", "column", "count",
                     *[F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f"{c}_ts") for c in
                       ("mean", "min", "p25", "p50", "p75", "max")])
    out = num.unionByName(cat, allowMissingColumns=True).unionByName(dtm, allowMissingColumns=True)
    return out.select("ordinal", "column", "count", "unique", "top", "freq", "mean", "std", "min",
                      "p25", "p50", "p75", "max", *[f"{c}_ts" for c in
                                                    ("mean", "min", "p25", "p50", "p75", "max")])


# ---------------------------------------------------------------- head, value counts

def sample_head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by the given order (Spark rows have no inherent order).
    Planned as TakeOrderedAndProject: each task keeps n rows."""
    keys = list(order_by) if order_by else df.columns[:1]
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def value_counts(df: DataFrame, column: str, n: int | None = 15) -> DataFrame:
    """``(value, count)`` most frequent first, missing excluded, ties by value."""
    dt = df.schema[column].dataType
    out = (df.filter(~is_missing(column, dt)).groupBy(col(column).alias(column))
             .agg(F.count(F.lit(1)).alias("count"))
             .orderBy(F.desc("count"), F.col(column)))
    return out.limit(n) if n else out
