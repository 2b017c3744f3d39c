"""Compare a Spark result with the oracle engine's result for the same
registered query: column names, row count and order-insensitive values
(floats to a relative tolerance, NaN as missing)."""

from __future__ import annotations

import math


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return str(v)


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def close(x, y, tolerance: float = 1e-6) -> bool:
    """Rows of equal text, but for numbers within a relative tolerance (last
    bits of sums depend on the order of addition)."""
    def near(s: str, t: str) -> bool:
        if s == t:
            return True
        try:
            return math.isclose(float(s), float(t), rel_tol=tolerance, abs_tol=1e-9)
        except ValueError:
            return False
    return len(x) == len(y) and all(near(s, t) for s, t in zip(x, y))


# Spark type name -> oracle type name, for the schema comparison.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
              "tinyint": "TINYINT", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(spark_df, duck_con, sql: str) -> tuple[bool, str]:
    """(equal?, message) for a Spark DataFrame against SQL run on ``duck_con``:
    column names, column types, row count and values."""
    scols = spark_df.columns
    stypes = dict(spark_df.dtypes)
    srows = [tuple(r) for r in spark_df.collect()]
    rel = duck_con.execute(sql)
    dcols = [d[0] for d in rel.description]
    dtypes = {d[0]: str(d[1]) for d in rel.description}
    drows = rel.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns spark={scols} oracle={dcols}"
    bad = {c: (stypes[c], dtypes[c]) for c in scols if TYPE_NAMES.get(stypes[c], stypes[c]) != dtypes[c]}
    if bad:
        return False, f"types differ {bad}"
    a, b = canonical(scols, srows), canonical(dcols, drows)
    if a == b or len(a) == len(b) and all(close(x, y) for x, y in zip(a, b)):
        return True, f"{len(a)} rows"
    sa, sb = set(a), set(b)
    return False, (f"rows spark={len(a)} oracle={len(b)}; spark only {list(sa - sb)[:2]}; "
                   f"oracle only {list(sb - sa)[:2]}")


def oracle_connection(sf_dir: str):
    import duckdb

    from .inputs import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con
