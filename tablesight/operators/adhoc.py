"""Ad-hoc SQL on loaded tables: the user's query runs through Spark's
parser, analyzer and optimizer; a display passes ``limit=DISPLAY_ROWS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DISPLAY_ROWS = 50  # fixed value: rows that a result display shows


def adhoc(spark: SparkSession, tables: dict[str, DataFrame], sql: str,
          limit: int | None = None) -> DataFrame:
    """Run ``sql`` where ``{name}`` refers to ``tables[name]`` (bound as
    parameters, no global views); the result is limited to ``limit`` rows
    (default: all)."""
    out = spark.sql(sql, **tables)
    return out.limit(limit) if limit else out
