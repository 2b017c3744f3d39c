"""Column classes, missing-value predicates and type-safe value forms.

Missing follows pandas ``isnull``: null everywhere, plus NaN in float
columns. Infinity is a value, not missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_INTERVAL = (T.DayTimeIntervalType, T.YearMonthIntervalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def col(name: str) -> Column:
    """Reference a column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    # Booleans are not NumericType in Spark; decimals are (numeric here too).
    return isinstance(dt, T.NumericType)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def is_interval(dt: T.DataType) -> bool:
    return isinstance(dt, _INTERVAL)


def column_class(dt: T.DataType) -> str:
    """Fine class of a column: numeric, boolean, datetime, interval, nested, text."""
    if is_numeric(dt):
        return "numeric"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_datetime(dt):
        return "datetime"
    if is_interval(dt):
        return "interval"
    if isinstance(dt, _NESTED):
        return "nested"
    return "text"


def classify(df: DataFrame) -> dict[str, list[str]]:
    """Column names per fine class, in schema order."""
    out: dict[str, list[str]] = {}
    for f in df.schema.fields:
        out.setdefault(column_class(f.dataType), []).append(f.name)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    """The reference's "categorical" class: every column that is not numeric."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns described by value frequencies (text, boolean, nested)."""
    return [f.name for f in df.schema.fields
            if column_class(f.dataType) in ("text", "boolean", "nested")]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def is_missing(name: str, dt: T.DataType) -> Column:
    c = col(name)
    if is_float(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean_numeric(name: str, dt: T.DataType) -> Column:
    """Numeric value as double with NaN turned into null, so aggregates skip it."""
    c = col(name).cast("double")
    if is_float(dt):
        return F.nanvl(c, F.lit(None).cast("double"))
    return c


def comparable(name: str, dt: T.DataType) -> Column:
    """A form of the column usable as a grouping key (maps are not)."""
    c = col(name)
    if isinstance(dt, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def as_text(name: str, dt: T.DataType) -> Column:
    """Value as text for long (unpivoted) tables; nested values as JSON."""
    c = col(name)
    if isinstance(dt, _NESTED):
        return F.to_json(c)
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def epoch_micros(name: str, dt: T.DataType) -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    c = col(name)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400_000_000)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, `{name}`)")
    return F.unix_micros(c)


def from_epoch_micros(c: Column) -> Column:
    """Back from epoch microseconds to a zone-less timestamp."""
    return F.timestamp_add("MICROSECOND", c.cast("long"), F.expr(EPOCH_NTZ))


# ---------------------------------------------------------------- SQL-text forms
# One F.expr call per expression instead of a py4j call per Column node.

def sql_col(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_is_missing(name: str, dt: T.DataType) -> str:
    c = sql_col(name)
    return f"({c} IS NULL OR isnan({c}))" if is_float(dt) else f"({c} IS NULL)"


def sql_clean_numeric(name: str, dt: T.DataType) -> str:
    c = f"CAST({sql_col(name)} AS DOUBLE)"
    return f"nanvl({c}, CAST(NULL AS DOUBLE))" if is_float(dt) else c


def sql_epoch_micros(name: str, dt: T.DataType) -> str:
    c = sql_col(name)
    if isinstance(dt, T.DateType):
        return f"(CAST(unix_date({c}) AS BIGINT) * 86400000000)"
    if isinstance(dt, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {c})"
    return f"unix_micros({c})"


def sql_as_text(name: str, dt: T.DataType) -> str:
    c = sql_col(name)
    if isinstance(dt, _NESTED):
        return f"to_json({c})"
    if isinstance(dt, T.BinaryType):
        return f"hex({c})"
    return f"CAST({c} AS STRING)"
