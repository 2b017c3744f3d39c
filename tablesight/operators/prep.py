"""Preparation for training: imputation, categorical indexing, scaling and
a deterministic train/test split.

Fill values and scaling statistics are one-row aggregates joined with
``crossJoin(broadcast(...))`` — never a window without ``partitionBy``,
which would run in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_numeric, col, is_missing, numeric_columns, sql_clean_numeric
from .common import column_names, join_back, unpivot
from .frequencies import top_values, value_hashes
from .profile import value_frequencies
from .quantiles import quantiles
from .report import top_per_column


def fill_values(df: DataFrame, strategy: str = "mean", cols: Sequence[str] | None = None,
                exact: bool = True) -> DataFrame:
    """One row with the fill value of every column: mean or median for
    numeric columns, the most frequent value (ties: smallest) for the rest."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else df.columns
    num = [c for c in cols if c in numeric_columns(df)]
    other = [c for c in cols if c not in num]
    parts = []
    if num and strategy == "mean":
        parts.append(df.agg(*[F.avg(clean_numeric(c, types[c])).alias(c) for c in num]))
    elif num and strategy == "median":
        q = quantiles(unpivot(df, num, lambda c: sql_clean_numeric(c, types[c]), names=False), [0.5],
                      keys=["ordinal"], exact=exact).join(F.broadcast(column_names(df, num)), "ordinal")
        parts.append(q.groupBy().pivot("column", num).agg(F.first(F.col("quantiles")[0])))
    elif num:
        other = other + num
    if other:
        top = top_values(df, value_hashes(df, other), 1, other).join(F.broadcast(column_names(df, other)), "ordinal")
        parts.append(top.groupBy().pivot("column", other).agg(F.first("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def impute(df: DataFrame, strategy: str = "mean", cols: Sequence[str] | None = None,
           exact: bool = True) -> DataFrame:
    """Replace missing values (null, NaN) column by column with
    ``fill_values``; numeric columns become double under mean/median."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else df.columns
    fv = fill_values(df, strategy, cols, exact)
    fv = fv.select(*[col(c).alias(f"_fill_{i}") for i, c in enumerate(cols)])
    pos = {c: i for i, c in enumerate(cols)}

    def filled(c: str):
        if c not in pos:
            return col(c)
        dt = types[c]
        f = F.col(f"_fill_{pos[c]}")
        if c in numeric_columns(df) and strategy in ("mean", "median"):
            return F.when(is_missing(c, dt), f.cast("double")).otherwise(col(c).cast("double")).alias(c)
        return F.when(is_missing(c, dt), f.cast(dt)).otherwise(col(c)).alias(c)

    return df.crossJoin(F.broadcast(fv)).select(*[filled(c) for c in df.columns])


MAX_CATEGORIES = 1_000_000


def category_index(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``(column, value, index, count)``: labels indexed by descending
    frequency, ties by value (StringIndexer's ``frequencyDesc`` order).
    Indexing ranks all labels of a column in one window task, so columns with
    more than ``max_categories`` labels are refused (use frequency encoding);
    nothing is dropped silently."""
    vf = value_frequencies(df, list(cols)).filter(F.col("value").isNotNull())
    n = vf.groupBy("column").count().filter(F.col("count") > max_categories).limit(1).collect()
    if n:
        raise ValueError(f"column {n[0]['column']} has over {max_categories} labels; use frequency_encode")
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return vf.select("column", "value", (F.row_number().over(w) - 1).cast("double").alias("index"),
                     F.col("n").cast("long").alias("count"))


def encode_index(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_index`` for each column; missing values get the index after
    the last label (StringIndexer ``handleInvalid='keep'``)."""
    idx = category_index(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    sizes = idx.groupBy("column").agg(F.count(F.lit(1)).alias("k"))
    out = df
    for c in cols:
        m = idx.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"{c}_index"))
        k = sizes.filter(F.col("column") == c).select(F.col("k").cast("double").alias(f"_k_{c}"))
        key = F.when(~is_missing(c, types[c]), col(c).cast("string"))
        out = (join_back(out.withColumn(f"_v_{c}", key), m, [f"_v_{c}"]).crossJoin(F.broadcast(k))
                  .withColumn(f"{c}_index", F.coalesce(F.col(f"{c}_index"), F.col(f"_k_{c}")))
                  .drop(f"_v_{c}", f"_k_{c}"))
    return out


def scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``<c>_scaled`` = (x - mean) / sample std; null when std is 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else numeric_columns(df)
    st = df.agg(*[F.avg(clean_numeric(c, types[c])).alias(f"_m{i}") for i, c in enumerate(cols)],
                *[F.stddev_samp(clean_numeric(c, types[c])).alias(f"_s{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(st))
    out = out.select("*", *[F.try_divide(clean_numeric(c, types[c]) - F.col(f"_m{i}"),
                                         F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}"))).alias(f"{c}_scaled")
                            for i, c in enumerate(cols)])
    return out.drop(*[f"_m{i}" for i in range(len(cols))], *[f"_s{i}" for i in range(len(cols))])


# Fixed value: Knuth's multiplicative hashing constant (2^32 / golden ratio).
KNUTH = 2654435761


def split_bucket(key: str, salt: int = 0, dt: T.DataType | None = None) -> F.Column:
    """Bucket 0..9999 of a key, reproducible in any SQL engine for integer
    keys: ((key + salt) * 2654435761) mod 2^32 mod 10000, exact: in 64-bit
    integers by halves of 16 bits, or in decimals if the type is not known.
    Other key types use xxhash64."""
    if isinstance(dt, T.IntegralType):
        k = F.pmod(F.pmod(col(key).cast("long"), F.lit(2 ** 32)) + F.lit(salt % 2 ** 32), F.lit(2 ** 32))
        high = F.shiftleft((F.shiftright(k, 16) * F.lit(KNUTH)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
        both = high + k.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(KNUTH)
        return F.pmod(both.bitwiseAND(F.lit(2 ** 32 - 1)), F.lit(10000).cast("long")).cast("int")
    if dt is None:
        k = (col(key).cast("decimal(38,0)") + F.lit(salt)) * F.lit(KNUTH)
        return F.pmod(F.pmod(k, F.lit(2 ** 32)), F.lit(10000)).cast("int")
    return F.pmod(F.xxhash64(col(key), F.lit(salt)), F.lit(10000)).cast("int")


def split(df: DataFrame, key: str, test_share: float = 0.2, salt: int = 0) -> DataFrame:
    """Add ``split`` = 'test' / 'train' by a hash of ``key``: the same row
    always lands on the same side, whatever the partitioning (unlike
    ``randomSplit``)."""
    b = split_bucket(key, salt, df.schema[key].dataType)
    return df.withColumn("split", F.when(b < int(round(test_share * 10000)), "test").otherwise("train"))


def one_hot(df: DataFrame, cols: Sequence[str], drop_last: bool = True) -> DataFrame:
    """Add ``<c>_onehot`` (array<double>) per column: labels indexed by
    descending frequency (ties by label), missing kept as an extra label,
    then one-hot encoded with Spark ML (``StringIndexer`` + ``OneHotEncoder``;
    the last category is dropped by default, as Spark does)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array
    cols = list(cols)
    idx = [f"_idx_{c}" for c in cols]
    vec = [f"_vec_{c}" for c in cols]
    model = Pipeline(stages=[
        StringIndexer(inputCols=cols, outputCols=idx, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=idx, outputCols=vec, handleInvalid="keep", dropLast=drop_last),
    ]).fit(df)
    out = model.transform(df)
    for c, v in zip(cols, vec):
        out = out.withColumn(f"{c}_onehot", vector_to_array(F.col(v)))
    return out.drop(*idx, *vec)
