"""Shared plan builders: per-column statistics in one job.

Rule: never loop jobs over columns. Statistics are written as SQL templates
(``"avg({v})"``) and turned into expressions with one ``F.expr`` call each —
building the same trees from Column objects costs a py4j round trip per node
and dominated small queries.

Narrow statistic sets are one wide ``agg`` (one scan, partial + final
HashAggregate) turned long with ``inline``. When the aggregation buffer
would exceed ``spark.sql.codegen.maxFields`` whole-stage code generation
switches off, so wider sets unpivot the columns into ``(ordinal, column,
value)`` rows and group by column instead (same single scan, codegen kept).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BUFFER_FIELDS = 90  # below Spark's default codegen field limit (100)

# Aggregation buffer slots of Spark's built-in aggregates.
BUFFER_FIELDS = {"avg": 2, "count": 1, "count_if": 1, "sum": 1, "min": 1, "max": 1, "stddev_samp": 3,
                 "var_samp": 3, "var_pop": 3, "skewness": 4, "kurtosis": 5, "covar_samp": 4, "corr": 6,
                 "regr_slope": 6, "approx_count_distinct": 52, "first": 2}

StatSQL = dict[str, str]


def q(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def buffer_fields(stats: StatSQL) -> int:
    found = set()
    for t in stats.values():
        found |= set(re.findall(r"\b([a-z_]+)\(", t))
    return sum(BUFFER_FIELDS.get(f, 0) for f in found) or 1


def per_column(df: DataFrame, cols: Sequence[str], value: Callable[[str], str], stats: StatSQL,
               max_fields: int = MAX_BUFFER_FIELDS) -> DataFrame:
    """Long table ``(ordinal, column, <stat>...)`` with one row per column.

    ``value(name)`` is the SQL expression aggregated for a column (e.g. a
    NaN-free double); ``stats`` maps output names to SQL templates over
    ``{v}``. ``ordinal`` is the position of the column in ``df``.
    """
    pos = {n: i for i, n in enumerate(df.columns)}
    cols = list(cols)
    if not cols:
        return _empty(df, stats)
    if len(cols) * buffer_fields(stats) <= max_fields:
        aggs = [F.expr(t.format(v=value(c))).alias(f"_{pos[c]}__{s}") for c in cols for s, t in stats.items()]
        wide = df.agg(*aggs)
        rows = ", ".join(
            f"struct({pos[c]} as ordinal, {lit(c)} as column, "
            + ", ".join(f"`_{pos[c]}__{s}` as {q(s)}" for s in stats) + ")" for c in cols)
        return wide.selectExpr(f"inline(array({rows}))")
    return per_column_long(unpivot(df, cols, value), stats, column_names(df, cols))


def unpivot(df: DataFrame, cols: Sequence[str], value: Callable[[str], str], names: bool = True) -> DataFrame:
    """``(ordinal, column, value)`` rows, one per cell of ``cols``; the values
    of all columns must share one type. ``names=False`` leaves out the column
    name (an integer key groups faster than a string)."""
    pos = {n: i for i, n in enumerate(df.columns)}
    if not cols:  # no such columns: an empty long table
        return df.limit(0).selectExpr("0 AS ordinal", *(["'' AS column"] if names else []),
                                      "CAST(NULL AS DOUBLE) AS value")
    name = (lambda c: f"{lit(c)} as column, ") if names else (lambda c: "")
    cells = ", ".join(f"struct({pos[c]} as ordinal, {name(c)}{value(c)} as value)" for c in cols)
    return df.selectExpr(f"inline(array({cells}))")


def per_column_long(long: DataFrame, stats: StatSQL, names: DataFrame) -> DataFrame:
    """One row for each of ``names``; a column without cells (no rows) gets
    what the statistics are over nothing: counts 0, others null."""
    found = long.groupBy("ordinal").agg(*[F.expr(t.format(v="value")).alias(s) for s, t in stats.items()])
    none = long.limit(0).agg(*[F.expr(t.format(v="value")).alias(f"_none_{s}") for s, t in stats.items()])
    return (names.join(found, "ordinal", "left").crossJoin(F.broadcast(none))
                 .select("ordinal", "column", *[F.coalesce(F.col(q(s)), F.col(q(f"_none_{s}"))).alias(s) for s in stats]))


def column_names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Small ``(ordinal, column)`` table for re-attaching names."""
    pos = {n: i for i, n in enumerate(df.columns)}
    return df.sparkSession.createDataFrame([(pos[c], c) for c in cols], "ordinal int, column string")


def _empty(df: DataFrame, stats: StatSQL) -> DataFrame:
    probe = df.limit(0).agg(F.lit(0).alias("ordinal"), F.lit("").alias("column"),
                            *[F.expr(t.format(v="cast(null as double)")).alias(s) for s, t in stats.items()])
    return probe.limit(0)


def join_back(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics ``small`` (one row per key) back to the rows of
    ``big`` on ``keys`` with null-safe equality (a missing key is a key).

    Spark broadcasts ``small`` when its size is under the broadcast threshold.
    Otherwise both sides are shuffled by key, and adaptive execution splits
    the partition of a hot key of ``big`` over several tasks.
    """
    keys = list(keys)
    sk = [f"_jk{i}" for i in range(len(keys))]
    right = small.select(*[F.col(q(k)).alias(s) for k, s in zip(keys, sk)],
                         *[F.col(q(c)) for c in small.columns if c not in keys])
    cond = None
    for k, s in zip(keys, sk):
        c = F.col(q(k)).eqNullSafe(F.col(s))
        cond = c if cond is None else cond & c
    return big.join(right, cond, how).drop(*sk)
