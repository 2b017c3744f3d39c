"""Aggregates behind the charts: correlation matrix, histograms, value
counts and the binned pair grid. Output size is bounded by the number of
columns and bins, never by the number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_numeric, col, numeric_columns, sql_clean_numeric
from ..functions.stats import corr_sql
from ..session import materialize
from .common import MAX_BUFFER_FIELDS, lit
from .profile import value_counts  # noqa: F401  (G3 is T4)

PAIR_FIELDS = 10  # buffer slots of one pairwise correlation (covariance + two deviations)
GRAM_COLUMNS = 512  # columns of a block: a task's sums take under 50 MB
GRAM_CELLS = 1 << 20  # cells of a batch that are worked on at once
REDO_PAIRS = 200  # pairs that a row emits at most where sums are not exact enough
#: Part of the mean square (about the column's mean) that a variance must pass: below, digits cancel.
ENOUGH = 1e-6


def _gram(vals: DataFrame, left: range, right: range, shifts: list[float]) -> DataFrame:
    """``(i, j, corr, redo)`` for the pairs i <= j of two blocks of columns:
    counts, sums, squares and products of values and presence masks as matrix
    products per task, added up by pair. redo: too many digits cancelled, or
    a sum isn't finite."""
    cols = [*left, *(c for c in right if c not in left)]
    at = {c: k for k, c in enumerate(cols)}
    pairs = [(i, j) for i in left for j in right if i <= j]
    rows, others = np.array([at[i] for i, _ in pairs]), np.array([at[j] for _, j in pairs])
    ids = np.array(pairs, np.int32)
    shift = np.array([shifts[c] for c in cols])

    def sums(batches):
        n = np.zeros((len(cols),) * 2)
        s, q, c = n.copy(), n.copy(), n.copy()
        for batch in batches:
            step = max(1, GRAM_CELLS // len(cols))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = np.column_stack([part.column(j).to_numpy(zero_copy_only=False) for j in range(len(cols))]).astype(np.float64)
                there = ~np.isnan(x)
                x = np.where(there, x - shift, 0.0)
                m = there.astype(np.float64)
                with np.errstate(all="ignore"):
                    n += m.T @ m
                    s += x.T @ m
                    q += (x * x).T @ m
                    c += x.T @ x
        for k in range(0, len(ids), 1 << 16):
            i, j = rows[k:k + (1 << 16)], others[k:k + (1 << 16)]
            cells = [ids[k:k + (1 << 16), 0], ids[k:k + (1 << 16), 1], n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cells], ["i", "j", "n", "sx", "sy", "qx", "qy", "xy"])

    parts = vals.select(*(f"_{c}" for c in cols)).mapInArrow(
        sums, "i int, j int, n double, sx double, sy double, qx double, qy double, xy double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "xy")))
    total = total.selectExpr("i", "j", "qx", "qy", "n * qx AS mx", "n * qy AS my", "n * qx - sx * sx AS vx", "n * qy - sy * sy AS vy", "n * xy - sx * sy AS v")
    total = total.withColumn("corr", F.expr("CASE WHEN vx > 0 AND vy > 0 THEN v / (sqrt(vx) * sqrt(vy)) END"))
    # All values at the shift (a constant column, or no rows) need no second look.
    redo = (f"qx <> 0 AND qy <> 0 AND NOT (vx > {ENOUGH} * mx AND vy > {ENOUGH} * my "
            "AND mx < double('inf') AND my < double('inf') AND abs(corr) < double('inf'))")
    return total.select("i", "j", "corr", F.expr(f"coalesce({redo}, true)").alias("redo"))


def _correlation_wide(vals: DataFrame, n: int) -> DataFrame:
    """``(i, j, corr)`` of many columns: one pass for the means that values are
    taken from, one for each pair of blocks of GRAM_COLUMNS columns, which
    reads these columns only. Pairs whose sums aren't exact enough (a column
    nearly constant where the other is present, infinite or huge values) go
    through Spark's own aggregates."""
    means = vals.selectExpr(*[f"CASE WHEN min(_{k}) = max(_{k}) THEN min(_{k}) ELSE avg(_{k}) END AS _{k}" for k in range(n)]).first()
    shifts = [x if x is not None and np.isfinite(x) else 0.0 for x in means]
    blocks = [range(k, min(k + GRAM_COLUMNS, n)) for k in range(0, n, GRAM_COLUMNS)]
    parts = [_gram(vals, x, y, shifts) for k, x in enumerate(blocks) for y in blocks[k:]]
    found = materialize(reduce(DataFrame.unionAll, parts), "correlation")
    redo = [(r["i"], r["j"]) for r in found.filter("redo").select("i", "j").collect()]  # at most a pair of columns each
    half = found.filter("NOT redo").select("i", "j", "corr")
    for k in range(0, len(redo), REDO_PAIRS):
        cells = ", ".join(f"struct({i} AS i, {j} AS j, _{i} AS a, _{j} AS b)" for i, j in redo[k:k + REDO_PAIRS])
        again = vals.selectExpr(f"inline(array({cells}))").groupBy("i", "j").agg(F.expr(corr_sql("a", "b")).alias("corr"))
        half = half.unionAll(again)
    return half


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(x, y, corr)`` over all ordered pairs of
    numeric columns, each pair over the rows where both are present; null
    where a side is constant. Each unordered pair is computed once: in one
    wide aggregate for a few pairs, otherwise by blocks of matrix products in
    each task, so a row is read once and emits nothing; a task gives one
    partial row per pair."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    vals = df.selectExpr(*[f"{sql_clean_numeric(c, types[c])} AS _{i}" for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(pairs) * PAIR_FIELDS <= MAX_BUFFER_FIELDS:
        wide = vals.agg(*[F.expr(corr_sql(f"_{i}", f"_{j}")).alias(f"c{i}_{j}") for i, j in pairs])
        cells = ", ".join(f"struct({lit(cols[i])} AS x, {lit(cols[j])} AS y, c{i}_{j} AS corr)" for i, j in pairs)
        half = wide.selectExpr(f"inline(array({cells}))")
    else:
        # every pair of columns has a row, also over an empty table
        names = df.sparkSession.createDataFrame(pa.table({
            "i": pa.array([i for i, _ in pairs], pa.int32()), "j": pa.array([j for _, j in pairs], pa.int32()),
            "x": [cols[i] for i, _ in pairs], "y": [cols[j] for _, j in pairs]}))
        half = _correlation_wide(vals, len(cols)).join(names, ["i", "j"], "right").select("x", "y", "corr")
    mirror = half.filter(F.col("x") != F.col("y")).select(F.col("y").alias("x"), F.col("x").alias("y"), "corr")
    return half.unionByName(mirror)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    # Equal-width bins over [lo, hi], last bin closed; a constant column is
    # widened to [v - 0.5, v + 0.5] like numpy.
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    idx = F.floor((x - lo2) / ((hi2 - lo2) / bins)).cast("int")
    return F.least(F.lit(bins - 1), idx)


def _edges(lo: Column, hi: Column, bins: int, b: Column):
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    w = (hi2 - lo2) / bins
    return (lo2 + b * w), F.when(b == bins - 1, hi2).otherwise(lo2 + (b + 1) * w)


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """``(column, bin, lower, upper, count)`` for every numeric column: one
    pass for the ranges (one row, broadcast), one for the counts; empty bins
    appear with count 0. Missing and infinite values are dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), clean_numeric(c, types[c]).alias("v")) for c in cols])))
    # Equal-width bins need a finite range: infinite values are left out here
    # and counted by the numeric report.
    long = long.filter(F.abs("v") < float("inf"))
    rng = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = (long.join(F.broadcast(rng), "column")
                  .groupBy("column", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
                  .agg(F.count(F.lit(1)).alias("n")))
    grid = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lower, upper = _edges(F.col("lo"), F.col("hi"), bins, F.col("bin"))
    return (grid.join(counts, ["column", "bin"], "left")
                .select("column", "bin", lower.alias("lower"), upper.alias("upper"),
                        F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, lower, upper, count)`` for one column (``plt.hist(x.dropna(), bins)``)."""
    return histograms(df, [column], bins).drop("column")


def pair_grid(df: DataFrame, k: int | None = None, bins: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Binned pair plot of the first ``k`` numeric columns (default: all) over rows complete
    in all of them: ``(x, y, bin_x, bin_y, n)`` for every ordered pair; the
    diagonal (x = y) is the histogram of x."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else numeric_columns(df)[:k]
    vals = df.select(*[clean_numeric(c, types[c]).alias(c) for c in cols]).na.drop("any")
    for c in cols:
        vals = vals.filter(F.abs(col(c)) < float("inf"))
    rng = vals.agg(*[F.min(col(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(col(c)).alias(f"hi{i}") for i, c in enumerate(cols)])
    b = vals.crossJoin(F.broadcast(rng)).select(*[
        _bin(col(c), F.col(f"lo{i}"), F.col(f"hi{i}"), bins).alias(f"b{i}") for i, c in enumerate(cols)])
    k = len(cols)
    cells = ", ".join(f"struct({i * k + j} AS p, b{i} AS bin_x, b{j} AS bin_y)" for i in range(k) for j in range(k))
    names = df.sparkSession.createDataFrame([(i * k + j, cols[i], cols[j]) for i in range(k) for j in range(k)],
                                            "p int, x string, y string")
    counts = b.selectExpr(f"inline(array({cells}))").groupBy("p", "bin_x", "bin_y").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(names), "p").select("x", "y", "bin_x", "bin_y", "n")


def scatter_sample(df: DataFrame, k: int | None = None, n: int = 1000, seed: int = 42,
                   cols: Sequence[str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` points for the pair plot's scatter cells (the feature: a
    sampling operator) of the rows complete in the first ``k`` numeric columns:
    the ``n`` rows with the smallest seeded hash of ``keys`` (default: the
    columns themselves), ties by the columns' values.

    The same rows whatever the partitioning; each task keeps n rows
    (TakeOrderedAndProject). Equal keys have equal hashes, so keys should tell
    rows apart.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)[:k]
    # The names of the columns may be the same as a helper's: helpers are numbered.
    by = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (keys or cols)]
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *by))
    rows = df.na.drop("any", subset=cols).select(F.struct(*[col(c) for c in cols]).alias("point"), draw.alias("draw"))
    return rows.orderBy("draw", "point").limit(n).select("point.*")
