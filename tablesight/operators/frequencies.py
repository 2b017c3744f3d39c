"""Frequencies of values of any length, without shuffling the values.

Phase 1 (``value_hashes``) groups 128-bit hashes of the values, with partial
aggregation: 16 bytes a value, and its first HEAD characters to order ties by.
Counts and numbers of distinct values come from this table alone, exactly (two
different values are taken as one with a chance of 2 ** -128).

Phase 2 (``top_values``) finds, column by column, the count and the head of the
k-th value; whatever may be among the first k is a candidate: fewer than k
values and those that tie with the k-th in count and head. Only candidates'
texts are read, by a semi-join on the hashes in a second scan, and only those
texts reach an exchange, once per task. So a column of nearly unique long texts
costs its hashes, not its texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sql_as_text, sql_is_missing
from ..session import materialize
from .common import unpivot

#: Characters of a value by which ties are ordered before texts are fetched.
HEAD = 16
#: Candidates (24 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 500_000

HASHES = {"h1": "CASE WHEN {v} IS NOT NULL THEN xxhash64({v}) END", "h2": "CASE WHEN {v} IS NOT NULL THEN xxhash64('second', {v}) END"}


def hashed(column: str) -> list[Column]:
    """Both hashes of a text column, null for null."""
    return [F.expr(t.format(v=column)).alias(name) for name, t in HASHES.items()]


def text_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, value)``: every cell as text, null if missing."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> str:
        return f"CASE WHEN NOT {sql_is_missing(c, types[c])} THEN {sql_as_text(c, types[c])} END"

    cells = unpivot(df, list(cols) if cols is not None else df.columns, text, names=False)
    return cells.select("ordinal", F.col("value").cast("string").alias("value"))


def grouped_hashes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, h1, h2, head, n)``: how often each distinct value of each
    column occurs; hashes and head are null for missing."""
    cells = text_cells(df, cols).select("ordinal", *hashed("value"), F.substring("value", 1, HEAD).alias("head"))
    return cells.groupBy("ordinal", "h1", "h2", "head").agg(F.count(F.lit(1)).alias("n"))


def value_hashes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``grouped_hashes``, written once, since several statistics read it."""
    return materialize(grouped_hashes(df, cols), "value-hashes")


def candidates(freqs: DataFrame, k: int) -> DataFrame:
    """``(ordinal, h1, h2, n)``: the values that may be among the first k."""
    present = freqs.filter(F.col("h1").isNotNull())
    w = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("head"))
    first = present.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    last = first.groupBy("ordinal").agg(F.max(F.struct("_r", "n", "head")).alias("last"))
    # One row per column.
    cut = F.broadcast(last.select("ordinal", F.col("last.n").alias("_n"), F.col("last.head").alias("_head")))
    keep = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("head") <= F.col("_head")))
    return present.join(cut, "ordinal").filter(keep).select("ordinal", "h1", "h2", "n")


def top_values(df: DataFrame, freqs: DataFrame, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, rank, value, n)``: the ``k`` most frequent present values of
    each column, ties by value. ``freqs`` is ``value_hashes`` of the same
    columns of ``df``."""
    wanted = materialize(candidates(freqs, k), "top-candidates")
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    cells = text_cells(df, cols).filter("value IS NOT NULL").select("ordinal", "value", *hashed("value"))
    found = cells.join(wanted, ["ordinal", "h1", "h2"]).select("ordinal", "value", "n").distinct()
    w = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("value"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("ordinal", "rank", "value", "n")
