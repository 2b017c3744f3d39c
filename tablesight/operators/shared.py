"""The whole-table profile from one scan.

``column_counts`` unpivots every column once and groups ``(ordinal, value)``
with partial aggregation: numeric and datetime columns as doubles (datetimes
as epoch microseconds), all others by 128-bit hashes, missing as null. Everything
``describe`` and the profile text need — counts, missing values, moments,
extremes, top values, exact quantiles — is then derived from this table of
distinct values, written once under the checkpoint folder since about ten
aggregates read it. A full profile costs one scan of the data instead of one
per statistic family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    categorical_columns, datetime_columns, from_epoch_micros, is_float, numeric_columns, sql_as_text,
    sql_clean_numeric, sql_col, sql_epoch_micros, sql_is_missing,
)
from ..session import materialize
from .common import column_names
from .frequencies import HEAD, hashed, top_values
from .quantiles import quantiles_from_counts

QUARTILES = (0.25, 0.5, 0.75)


def column_counts(df: DataFrame) -> DataFrame:
    """``(ordinal, num, h1, h2, head, n)``: distinct values of every column with
    their counts (``num`` for numeric and datetime columns, the hashes and first
    characters of the text otherwise; all null for missing). No text is shuffled."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num, dts = set(numeric_columns(df)), set(datetime_columns(df))
    cells = []
    for i, c in enumerate(df.columns):
        dt = types[c]
        if c in num:
            v, t = sql_clean_numeric(c, dt), "CAST(NULL AS STRING)"
        elif c in dts:
            v, t = f"CAST({sql_epoch_micros(c, dt)} AS DOUBLE)", "CAST(NULL AS STRING)"
        else:
            v = "CAST(NULL AS DOUBLE)"
            t = f"CASE WHEN NOT {sql_is_missing(c, dt)} THEN {sql_as_text(c, dt)} END"
        cells.append(f"struct({i} AS ordinal, {v} AS num, {t} AS text)")
    if not cells:
        return df.limit(0).selectExpr("0 AS ordinal", "CAST(NULL AS DOUBLE) AS num", "CAST(NULL AS BIGINT) AS h1", "CAST(NULL AS BIGINT) AS h2",
                                      "CAST(NULL AS STRING) AS head", "CAST(0 AS BIGINT) AS n")
    counts = (df.selectExpr(f"inline(array({', '.join(cells)}))")
                .select("ordinal", "num", *hashed("text"), F.substring("text", 1, HEAD).alias("head"))
                .groupBy("ordinal", "num", "h1", "h2", "head").agg(F.count(F.lit(1)).alias("n")))
    # read by every statistic below: written once, whatever its size
    return materialize(counts, "column-counts")


def missing_from_counts(df: DataFrame, cc: DataFrame) -> DataFrame:
    """``(ordinal, column, missing, non_null)``."""
    st = cc.groupBy("ordinal").agg(
        F.sum(F.when(F.col("num").isNull() & F.col("h1").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("num").isNotNull() | F.col("h1").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"))
    return (F.broadcast(column_names(df, df.columns)).join(st, "ordinal", "left")
              .select("ordinal", "column", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
                      F.coalesce("non_null", F.lit(0)).cast("long").alias("non_null")))


def _moments(vals: DataFrame) -> DataFrame:
    # count, mean, min, max, sample std from distinct values with counts (two small passes)
    m = vals.groupBy("ordinal").agg(F.sum("n").alias("count"), (F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("mean"),
                                    F.min("num").alias("min"), F.max("num").alias("max"),
                                    (F.sum(F.col("num").cast("decimal(38,0)") * F.col("n")) / F.sum("n")).alias("_dmean"),
                                    F.sum(F.col("num").cast("decimal(38,0)") * F.col("n")).alias("_dsum"))
    dev = (vals.join(F.broadcast(m.select("ordinal", "mean")), "ordinal")
               .groupBy("ordinal").agg(F.sum(F.col("n") * (F.col("num") - F.col("mean")) ** 2).alias("_ss")))
    return m.join(dev, "ordinal").withColumn(
        "std", F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))))


def describe_shared(df: DataFrame, cc: DataFrame | None = None) -> DataFrame:
    """The combined ``describe`` table (same columns as ``profile.describe``)
    from one scan (``column_counts``)."""
    cc = cc if cc is not None else column_counts(df)
    pos = {c: i for i, c in enumerate(df.columns)}
    num = [pos[c] for c in numeric_columns(df)]
    dts = [pos[c] for c in datetime_columns(df)]
    cat = [pos[c] for c in categorical_columns(df)]
    names = F.broadcast(column_names(df, df.columns))
    vals = cc.filter(F.col("num").isNotNull()).select("ordinal", "num", "n")
    mom = _moments(vals)
    q = quantiles_from_counts(vals.withColumnRenamed("num", "v"), QUARTILES, ["ordinal"])
    both = mom.join(q, "ordinal", "left")
    numeric = (both.filter(F.col("ordinal").isin(num)).join(names, "ordinal").select(
        "ordinal", "column", F.col("count").cast("long").alias("count"), "mean", "std", "min",
        F.col("quantiles")[0].alias("p25"), F.col("quantiles")[1].alias("p50"),
        F.col("quantiles")[2].alias("p75"), "max"))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ts = lambda c: F.date_format(from_epoch_micros(F.floor(c)), fmt)
    dmean = F.expr("CAST(_dsum div count AS BIGINT)")
    dtm = (both.filter(F.col("ordinal").isin(dts)).join(names, "ordinal").select(
        "ordinal", "column", F.col("count").cast("long").alias("count"),
        F.date_format(from_epoch_micros(dmean), fmt).alias("mean_ts"), ts(F.col("min")).alias("min_ts"),
        ts(F.col("quantiles")[0]).alias("p25_ts"), ts(F.col("quantiles")[1]).alias("p50_ts"),
        ts(F.col("quantiles")[2]).alias("p75_ts"), ts(F.col("max")).alias("max_ts")))
    freqs = cc.filter(F.col("ordinal").isin(cat) & F.col("h1").isNotNull())
    cats = freqs.groupBy("ordinal").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    top = top_values(df, freqs, 1, categorical_columns(df)).select("ordinal", F.col("value").alias("top"), F.col("n").alias("freq"))
    categ = (names.filter(F.col("ordinal").isin(cat)).join(cats, "ordinal", "left").join(top, "ordinal", "left").select(
        "ordinal", "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "top", F.col("freq").cast("long").alias("freq")))
    # numeric and datetime columns with no present value still get a row
    seen = names.filter(F.col("ordinal").isin(num + dts)).join(both.select("ordinal"), "ordinal", "left_anti")
    empty = seen.select("ordinal", "column", F.lit(0).cast("long").alias("count"))
    out = (numeric.unionByName(categ, allowMissingColumns=True).unionByName(dtm, allowMissingColumns=True)
                  .unionByName(empty, allowMissingColumns=True))
    return out.select("ordinal", "column", "count", "unique", "top", "freq", "mean", "std", "min",
                      "p25", "p50", "p75", "max", *[f"{c}_ts" for c in ("mean", "min", "p25", "p50", "p75", "max")])
