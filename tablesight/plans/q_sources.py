"""Registered reader and text-output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile_text as PT
from ..session import scratch_path
from ..sources import readers as S
from ..sources.workbooks import read_workbooks
from . import oracle as O
from .inputs import oracle_from, workbooks
from .registry import T, register

_TOKENS = ", ".join("'" + t + "'" for t in S.NA_TOKENS)


@register("source_format", "select 'PARQUET' as format, count(*) as rows from orders")
def source_format(spark, sf):
    df = S.read_dataset(spark, f"{sf}/orders.parquet")
    return df.groupBy(S.format_label().alias("format")).agg(F.count(F.lit(1)).alias("rows"))


def _norm(c: str) -> str:
    return f"case when {c} in ({_TOKENS}) then null else {c} end"


@register("normalize_missing", oracle_from("text_orders") + "select "
          + ", ".join(f"{_norm(c)} as {c}" for c in O.cols("text_orders")) + " from text_orders")
def normalize_missing(spark, sf):
    return S.normalize_missing(T(spark, sf, "text_orders"))


def _decision_sql() -> str:
    parts = []
    for i, c in enumerate(O.cols("text_orders")):
        v = f"({_norm(c)})"
        p = f"count({v})"
        n_i = f"count(*) filter (where regexp_full_match({v}, '\\s*[+-]?[0-9]+\\s*') and try_cast(trim({v}) as bigint) is not null)"
        n_f = (f"count(*) filter (where regexp_full_match({v}, '\\s*[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?|[iI]nf|[iI]nfinity)\\s*')"
               f" and try_cast(trim({v}) as double) is not null)")
        n_b = f"count(*) filter (where lower(trim({v})) in ('true', 'false'))"
        parts.append(f"""select {i} as ordinal, '{c}' as "column",
  case when {p} = 0 then 'double' when {n_i} = {p} then 'bigint' when {n_f} = {p} then 'double'
       when {n_b} = {p} then 'boolean' else 'string' end as dtype from text_orders""")
    return oracle_from("text_orders") + O.union_all(parts)


@register("infer_types", _decision_sql())
def infer_types(spark, sf):
    return S.type_decisions(S.normalize_missing(T(spark, sf, "text_orders")))


@register("csv_roundtrip", oracle_from("text_orders") + f"""
select cast({_norm('o_orderkey')} as bigint) as o_orderkey, cast({_norm('o_custkey')} as bigint) as o_custkey,
       {_norm('o_orderstatus')} as o_orderstatus, cast({_norm('o_totalprice')} as double) as o_totalprice,
       {_norm('o_orderdate')} as o_orderdate, {_norm('o_orderpriority')} as o_orderpriority,
       {_norm('o_flag')} = 'true' as o_flag
from text_orders""")
def csv_roundtrip(spark, sf):
    """Orders as text with missing spellings, written as CSV to the shared
    folder and read back with token normalisation and type inference."""
    path = scratch_path(spark, "csv-roundtrip")
    T(spark, sf, "text_orders").write.option("header", True).csv(path)
    return S.read_dataset(spark, path, fmt="csv")


def _or_null(c: str) -> str:
    return f"case when {c} in ({_TOKENS}) then null else {c} end as {c}"


@register("csv_quoted_newlines", f"""
select doc_id, {_or_null('text')}, {_or_null('lang')}, {_or_null('source')}, n_chars from documents""")
def csv_quoted_newlines(spark, sf):
    """Documents, whose texts hold newlines, quotes and separators, written as
    CSV to the shared folder and read back in blocks."""
    path = scratch_path(spark, "csv-documents")
    form = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    T(spark, sf, "documents").write.options(**form).csv(path)
    return S.read_csv(spark, path, multiline="split")


@register("json_roundtrip", "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice from part")
def json_roundtrip(spark, sf):
    """Parts written as JSON Lines and read back with shape detection."""
    path = scratch_path(spark, "json-roundtrip")
    T(spark, sf, "part").write.json(path)
    return S.read_json(spark, path).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _profile_sql() -> str:
    t = "dirty_orders"
    types = dict(O.SCHEMAS[t])
    pos = {c: i for i, c in enumerate(types)}
    miss = {c: O.missing(c, ty) for c, ty in types.items()}
    s1 = [f"select 1 as section, {pos[c]} as ordinal, printf('%d %s %d non-null %s', {pos[c]}, '{c}', "
          f"count(*) filter (where not {miss[c]}), '{ty}') as line from {t}" for c, ty in types.items()]
    s2 = [f"select 2, {pos[c]}, printf('%s %d', '{c}', n) from (select count(*) filter (where {miss[c]}) as n from {t}) where n > 0"
          for c in types]
    s2.append(f"select 2, 0, 'No missing values.' from (select {O.missing_total(t)} as n from {t}) where n = 0")
    f4 = lambda e: f"coalesce(printf('%.4f', {e}), 'NaN')"
    s3 = []
    for c in O.numeric(t):
        v = O.clean(c, types[c])
        s3.append(f"""select 3, {pos[c]}, printf('%s count=%d mean=%s std=%s min=%s p25=%s p50=%s p75=%s max=%s', '{c}', count(v),
  {f4('avg(v)')}, {f4('stddev_samp(v)')}, {f4('min(v)')}, {f4('quantile_cont(v, 0.25)')}, {f4('quantile_cont(v, 0.5)')},
  {f4('quantile_cont(v, 0.75)')}, {f4('max(v)')}) from (select {v} as v from {t})""")
    for c in O.categorical(t):
        s3.append(f"""select 3, {pos[c]}, printf('%s count=%d unique=%d top=%s freq=%s', '{c}', sum(n), count(*),
  coalesce(arg_min(value, (-n, value)), 'NaN'), coalesce(cast(max(n) as varchar), 'NaN'))
  from (select {c} as value, count(*) as n from {t} where {c} is not null group by 1)""")
    for c in O.datetimes(t):
        ts = lambda e: f"strftime(make_timestamp(cast(floor({e}) as bigint)), '%Y-%m-%d %H:%M:%S.%f')"
        s3.append(f"""select 3, {pos[c]}, printf('%s count=%d mean=%s min=%s p25=%s p50=%s p75=%s max=%s', '{c}', count(v),
  strftime(make_timestamp(cast(min(m.mn) + sum(v - m.mn) // count(v) as bigint)), '%Y-%m-%d %H:%M:%S.%f'),
  {ts('min(v)')}, {ts('quantile_cont(v, 0.25)')}, {ts('quantile_cont(v, 0.5)')}, {ts('quantile_cont(v, 0.75)')}, {ts('max(v)')})
  from (select epoch_us({c}) as v from {t}) s, (select min(epoch_us({c})) as mn from {t}) m""")
    cells = []
    for c, ty in types.items():
        if ty.startswith("timestamp"):
            cells.append(f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), 'NaN')")
        else:
            cells.append(f"coalesce(cast({c} as varchar), 'NaN')")
    s4 = [f"select 4, cast(row_number() over (order by o_orderkey) - 1 as integer), concat_ws(' | ', {', '.join(cells)}) "
          f"from (select * from {t} order by o_orderkey limit 5)"]
    return oracle_from(t) + O.union_all(s1 + s2 + s3 + s4)


@register("profile_sections", _profile_sql())
def profile_sections(spark, sf):
    df = T(spark, sf, "dirty_orders")
    out = PT.profile_sections(df, ["o_orderkey"])
    return out


@register("report_html")
def report_html(spark, sf):
    """HTML report lines for orders (rows-only check)."""
    return PT.report_html(T(spark, sf, "orders"))


@register("excel_workbooks", oracle_from("dirty_orders") + "select * from dirty_orders")
def excel_workbooks(spark, sf):
    """Orders with missing cells, read back from workbooks: numbers, texts, and
    dates told by their number format."""
    return read_workbooks(workbooks(T(spark, sf, "dirty_orders"), "o_orderkey"), S.NA_TOKENS)
