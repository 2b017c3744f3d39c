"""Named queries over the driver tables, each with its oracle SQL.

Every query reads whole tables at ``sf_dir`` (or inputs Spark derives from
them) and returns a DataFrame; doubles are rounded to 4 digits in both the
Spark result and the SQL so last-bit differences of float sums between
engines do not matter. The SQL is an independent formulation of the same
result, not generated from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import round_doubles
from . import oracle as O
from .inputs import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int | None = 4):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return round_doubles(out, digits) if digits is not None else out
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = O.rewrite_round(sql.strip())
        return run
    return deco


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # Importing the plan modules registers their queries.
    from . import (  # noqa: F401
        q_profile, q_compare, q_charts, q_report, q_health, q_features, q_models, q_chat, q_sources,
    )


T = table


def stats_view(df: DataFrame) -> DataFrame:
    """Stats record with the column lists as comma-joined text."""
    return df.select(*[F.array_join(c, ",").alias(c) if c in
                       ("columns_list", "numeric_columns", "categorical_columns") else F.col(c)
                       for c in df.columns])
