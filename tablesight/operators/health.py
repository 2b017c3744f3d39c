"""Data health checks, problem type and model advice, computed instead of
asked for: missing values, skew, high cardinality, leakage, summary facts.

Thresholds are parameters; the defaults are ours (documented in README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    as_text, categorical_columns, classify, col, datetime_columns, epoch_micros, is_missing, numeric_columns,
    sql_clean_numeric, sql_epoch_micros,
)
from ..functions.stats import SKEWNESS_SQL, corr_sql
from .common import per_column, unpivot
from .profile import dataset_stats, missing_counts
from .quantiles import quantiles
from .report import report_variables

# Default thresholds of the health checks.
DEFAULTS = {
    "missing_warn": 0.05, "missing_severe": 0.5,
    "skew": 1.0,
    "max_distinct": 50, "max_distinct_ratio": 0.5,
    "leak_information": 0.9, "bins": 16,
    "leak_corr": 0.95, "leak_share": 0.99, "id_ratio": 0.5,
    "class_max_distinct": 20, "ts_distinct_ratio": 0.9,
}


def health_missing(df: DataFrame, warn: float = DEFAULTS["missing_warn"],
                   severe: float = DEFAULTS["missing_severe"]) -> DataFrame:
    """``(column, missing_ratio, severity)`` for columns missing above ``warn``."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    m = missing_counts(df).crossJoin(F.broadcast(rows)).select(
        "column", F.try_divide(F.col("missing").cast("double"), F.col("_rows")).alias("missing_ratio"))
    return m.filter(F.col("missing_ratio") > warn).withColumn(
        "severity", F.when(F.col("missing_ratio") > severe, "severe").otherwise("warning"))


def health_skew(df: DataFrame, threshold: float = DEFAULTS["skew"]) -> DataFrame:
    """``(column, skewness)`` for numeric columns with |adjusted skewness| above threshold."""
    types = {f.name: f.dataType for f in df.schema.fields}
    st = per_column(df, numeric_columns(df), lambda c: sql_clean_numeric(c, types[c]), {"skewness": SKEWNESS_SQL})
    return st.filter(F.abs("skewness") > threshold).select("column", "skewness")


def health_cardinality(df: DataFrame, max_distinct: int = DEFAULTS["max_distinct"],
                       max_ratio: float = DEFAULTS["max_distinct_ratio"], exact: bool = True) -> DataFrame:
    """``(column, distinct, distinct_ratio)`` for categorical columns with more
    than ``max_distinct`` values or distinct/present above ``max_ratio``."""
    cats = categorical_columns(df)
    v = report_variables(df.select(*[col(c) for c in cats]), exact=exact) if cats else None
    if v is None:
        return df.sparkSession.createDataFrame([], "column string, distinct long, distinct_ratio double")
    v = v.select("column", "distinct", (F.col("distinct_pct") / 100).alias("distinct_ratio"))
    return v.filter((F.col("distinct") > max_distinct) | (F.col("distinct_ratio") > max_ratio))


def health_leakage(df: DataFrame, target: str, corr: float = DEFAULTS["leak_corr"],
                   share: float = DEFAULTS["leak_share"], id_ratio: float = DEFAULTS["id_ratio"],
                   class_max_distinct: int = DEFAULTS["class_max_distinct"]) -> DataFrame:
    """``(column, measure, value)``: features that nearly determine the target.

    Numeric target with more than ``class_max_distinct`` values (a
    regression target): |Pearson corr| >= ``corr`` with each numeric feature,
    and for each other feature the correlation ratio, the root of the share of
    the target's variance that lies between the feature's values, adjusted for
    their number: 1 - (1 - share) * (n - 1) / (n - values). Missing is a value.
    Class targets: for each feature, the share of rows whose feature value
    maps to its majority target value; identifiers (distinct/rows >=
    ``id_ratio``) are excluded since they trivially map to one target.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = [c for c in df.columns if c != target]
    regression = False
    if target in numeric_columns(df):
        # one small aggregate decides the plan shape (at most max+1 values kept)
        seen = df.select(col(target)).filter(col(target).isNotNull()).distinct().limit(class_max_distinct + 1)
        regression = seen.count() > class_max_distinct
    if regression:
        num = [c for c in feats if c in numeric_columns(df)]
        ratios = correlation_ratios(df, target, [c for c in feats if c not in num]).filter(F.col("value") >= corr).select(
            "column", F.lit("correlation_ratio").alias("measure"), "value")
        if not num:
            return ratios
        t = sql_clean_numeric(target, types[target])
        st = per_column(df, num, lambda c: f"named_struct('x', {sql_clean_numeric(c, types[c])}, 'y', {t})",
                        {"value": corr_sql("{v}.x", "{v}.y")})
        return st.filter(F.abs("value") >= corr).select(
            "column", F.lit("abs_corr").alias("measure"), F.abs("value").alias("value")).unionByName(ratios)
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.when(~is_missing(c, types[c]), as_text(c, types[c])).alias("v")) for c in feats])
    long = df.select(as_text(target, types[target]).alias("_t"), F.inline(cells))
    pair = long.groupBy("column", "v", "_t").agg(F.count(F.lit(1)).alias("n"))
    best = pair.groupBy("column", "v").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    # one grouping gives the share, the distinct values and the row count per feature;
    # identifiers (distinct present values / rows >= id_ratio) are left out
    per = best.groupBy("column").agg((F.sum("m") / F.sum("s")).alias("value"),
                                     (F.count("v") / F.sum("s")).alias("_ratio"))
    return (per.filter((F.col("_ratio") < id_ratio) & (F.col("value") >= share))
               .select("column", F.lit("majority_share").alias("measure"), "value"))


def correlation_ratios(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """``(column, value)``: the adjusted correlation ratio of a numeric target
    with each column's values, null without variance or with a value per row.

    One grouped pass: per hash of a value the count, sum and sum of squares of
    the target's differences from its mean (so that large values lose no
    digits); no text is shuffled and a hot value is one partial row a task."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value double")
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.xxhash64(F.when(~is_missing(c, types[c]), as_text(c, types[c]))).alias("h1"),
                               F.xxhash64(F.lit("second"), as_text(c, types[c]), is_missing(c, types[c])).alias("h2")) for i, c in enumerate(cols)])
    rows = df.select(F.expr(sql_clean_numeric(target, types[target])).alias("t"), cells.alias("cells")).filter("abs(t) < double('inf')")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("t").alias("mean"))))
    long = rows.select((F.col("t") - F.col("mean")).alias("d"), F.inline("cells"))
    groups = long.groupBy("ordinal", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") ** 2).alias("ss"))
    a = groups.groupBy("ordinal").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between"),
                                      F.sum("ss").alias("total"))
    share = 1 - (1 - F.try_divide("between", "total")) * F.try_divide(F.col("n") - 1, F.col("n") - F.col("k"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "ordinal int, column string")
    return a.join(F.broadcast(names), "ordinal").select("column", F.when(share.isNotNull(), F.sqrt(F.greatest(share, F.lit(0.0)))).alias("value"))


def health_information(df: DataFrame, target: str, share: float = DEFAULTS["leak_information"], bins: int = DEFAULTS["bins"],
                       id_ratio: float = DEFAULTS["id_ratio"]) -> DataFrame:
    """``(column, mutual_information, share)``: features of any type that tell
    ``share`` of the target's entropy or more, in whatever form (leakage that
    neither a correlation nor a majority value shows).

    Numbers and datetimes, the target too, are cut at ``bins`` exact quantiles;
    other columns count by value; missing is a value. mutual_information is in
    nats. share is it, less what chance gives that many values, (pairs -
    values - target values + 1) / 2n, over the target's entropy, from 0 to 1. Identifiers
    (values / rows >= ``id_ratio``) are left out; a constant target gives no rows.

    With n ln n summed over pairs, values and target values the entropies
    follow, so one grouped pass does and no counts are joined. Hashes stand
    for values; a hot value is one partial row a task and target value.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    at = {c: i for i, c in enumerate(df.columns)}
    feats = [c for c in df.columns if c != target]
    if not feats:
        return df.sparkSession.createDataFrame([], "column string, mutual_information double, share double")
    num, dts = set(numeric_columns(df)), set(datetime_columns(df))

    def number(c: str) -> str:
        return sql_clean_numeric(c, types[c]) if c in num else f"CAST({sql_epoch_micros(c, types[c])} AS DOUBLE)"

    ranked = [c for c in df.columns if c in num | dts]
    held = max(["edges", *df.columns], key=len) + "_"
    edges = quantiles(unpivot(df, ranked, number, names=False), [i / bins for i in range(1, bins)], keys=["ordinal"])
    # One row: bins - 1 numbers for each column.
    edges = edges.agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "quantiles"))).alias(held))

    def value(c: str) -> F.Column:
        if c in num | dts:
            v = F.expr(number(c))
            below = F.size(F.filter(F.element_at(held, F.lit(at[c])), lambda e: e < v)).cast("long")
            return F.struct(F.when(v.isNotNull(), below).alias("a"), F.lit(0).cast("long").alias("b"))
        present = ~is_missing(c, types[c])
        text = F.when(present, as_text(c, types[c]))
        return F.struct(F.when(present, F.xxhash64(text)).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))

    def sums(n: str) -> F.Column:
        return F.sum(F.col(n) * F.log(F.col(n).cast("double")))

    rows = df.crossJoin(F.broadcast(edges))
    # One column, so that no name of the table is taken for an alias.
    cells = rows.select(F.struct(value(target).alias("y"), F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("x")) for c in feats]).alias("xs")).alias("c"))
    long = cells.select("c.y", F.inline("c.xs"))
    pairs = long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    values = pairs.groupBy("column", "x").agg(F.sum("n").alias("nx"), F.count(F.lit(1)).alias("pairs"), sums("n").alias("joint"))
    per = values.groupBy("column").agg(F.sum("nx").alias("n"), F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("values"),
                                       F.sum("joint").alias("joint"), sums("nx").alias("own"))
    marginal = rows.select(value(target).alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("ny"))
    marginal = marginal.agg(sums("ny").alias("of_target"), F.count(F.lit(1)).alias("targets"))
    n = F.col("n").cast("double")
    information = F.greatest((F.col("joint") - F.col("own") - F.col("of_target")) / n + F.log(n), F.lit(0.0))
    entropy = F.log(n) - F.col("of_target") / n
    chance = (F.col("pairs") - F.col("values") - F.col("targets") + 1) / (2 * n)
    out = per.crossJoin(F.broadcast(marginal)).filter((F.col("targets") > 1) & (F.col("values") / n < id_ratio)).select(
        "column", information.alias("mutual_information"), F.least(F.greatest((information - chance) / entropy, F.lit(0.0)), F.lit(1.0)).alias("share"))
    return out.filter(F.col("share") >= share)


def health_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(check, column, value, severity)``: union of all checks."""
    parts = [
        health_missing(df).select(F.lit("missing").alias("check"), "column",
                                  F.col("missing_ratio").alias("value"), "severity"),
        health_skew(df).select(F.lit("skewed").alias("check"), "column",
                               F.col("skewness").alias("value"), F.lit("warning").alias("severity")),
        health_cardinality(df).select(F.lit("high_cardinality").alias("check"), "column",
                                      F.col("distinct").cast("double").alias("value"),
                                      F.lit("warning").alias("severity")),
    ]
    if target:
        parts.append(health_leakage(df, target).select(F.lit("leakage").alias("check"), "column", "value",
                                                       F.lit("severe").alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_facts(df: DataFrame, name: str = "") -> DataFrame:
    """``(fact, value)``: rows, columns, count per class, and the first and
    last timestamp over all datetime columns."""
    cls = classify(df)
    s = dataset_stats(df, name)
    types = {f.name: f.dataType for f in df.schema.fields}
    dts = datetime_columns(df)
    facts = [F.struct(F.lit("rows").alias("fact"), F.col("rows").cast("string").alias("value")),
             F.struct(F.lit("columns").alias("fact"), F.col("columns").cast("string").alias("value"))]
    facts += [F.struct(F.lit(f"n_{k}").alias("fact"), F.lit(str(len(v))).alias("value")) for k, v in sorted(cls.items())]
    out = s.select(F.inline(F.array(*facts)))
    if dts:
        from ..functions.columns import from_epoch_micros
        lo = [F.min(epoch_micros(c, types[c])) for c in dts]
        hi = [F.max(epoch_micros(c, types[c])) for c in dts]
        span = df.agg((F.least(*lo) if len(lo) > 1 else lo[0]).alias("lo"),
                      (F.greatest(*hi) if len(hi) > 1 else hi[0]).alias("hi"))
        out = out.unionByName(span.select(F.inline(F.array(
            F.struct(F.lit("first_timestamp").alias("fact"), from_epoch_micros(F.col("lo")).cast("string").alias("value")),
            F.struct(F.lit("last_timestamp").alias("fact"), from_epoch_micros(F.col("hi")).cast("string").alias("value"))))))
    return out


def problem_type(df: DataFrame, target: str | None = None,
                 class_max_distinct: int = DEFAULTS["class_max_distinct"],
                 ts_ratio: float = DEFAULTS["ts_distinct_ratio"]) -> DataFrame:
    """One row ``(target, problem_type, target_distinct, n_classes, rows)``.

    No target: clustering. Non-numeric target, or at most
    ``class_max_distinct`` values: classification. Numeric target with more
    values and a timestamp column whose distinct ratio reaches ``ts_ratio``:
    time-series. Otherwise regression.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if not target:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(None).cast("string").alias("target"), F.lit("clustering").alias("problem_type"),
            F.lit(None).cast("long").alias("target_distinct"), F.lit(None).cast("long").alias("n_classes"), "rows")
    dts = datetime_columns(df)
    tgt = F.when(~is_missing(target, types[target]), col(target))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(tgt).alias("td")]
    aggs += [F.count_distinct(col(c)).alias(f"_d{i}") for i, c in enumerate(dts)]
    st = df.agg(*aggs)
    ts_like = F.lit(False)
    for i in range(len(dts)):
        ts_like = ts_like | (F.col(f"_d{i}") >= F.col("rows") * ts_ratio)
    numeric_t = target in numeric_columns(df)
    kind = (F.when(F.lit(not numeric_t) | (F.col("td") <= class_max_distinct), "classification")
             .when(ts_like, "time-series").otherwise("regression"))
    return st.select(F.lit(target).alias("target"), kind.alias("problem_type"),
                     F.col("td").cast("long").alias("target_distinct"),
                     F.when(kind == "classification", F.col("td")).cast("long").alias("n_classes"),
                     F.col("rows").cast("long").alias("rows"))


# Recommended models per problem type, with the conditions
# (min classes, max classes, min rows) under which each applies.
MODEL_TABLE = [
    ("classification", "Random Forest", 2, None, 50),
    ("classification", "Boosted Trees", 2, 2, 200),
    ("classification", "Decision Tree", 3, None, 0),
    ("classification", "Logistic Regression", 2, None, 0),
    ("regression", "Random Forest", None, None, 50),
    ("regression", "Boosted Trees", None, None, 200),
    ("regression", "Linear Regression", None, None, 0),
    ("time-series", "Random Forest", None, None, 50),
    ("time-series", "Boosted Trees", None, None, 200),
    ("time-series", "Linear Regression", None, None, 0),
    ("clustering", "K-Means", None, None, 0),
    ("clustering", "Gaussian Mixture", None, None, 50),
]


def recommend_models(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(problem_type, model, rank)``: the model table joined with the
    problem type, filtered by class count and row count (models of many
    parameters need more rows)."""
    pt = problem_type(df, target)
    mt = df.sparkSession.createDataFrame(
        [(p, m, i, lo, hi, rows) for i, (p, m, lo, hi, rows) in enumerate(MODEL_TABLE)],
        "problem_type string, model string, pos int, min_classes int, max_classes int, min_rows int")
    j = F.broadcast(mt).join(pt, "problem_type")
    ok = ((F.col("min_classes").isNull() | (F.col("n_classes") >= F.col("min_classes")))
          & (F.col("max_classes").isNull() | (F.col("n_classes") <= F.col("max_classes")))
          & (F.col("rows") >= F.col("min_rows")))
    out = j.filter(ok)
    from pyspark.sql import Window
    return out.select("problem_type", "model",
                      F.row_number().over(Window.partitionBy("problem_type").orderBy("pos")).alias("rank"))
