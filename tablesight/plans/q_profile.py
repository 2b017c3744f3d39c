"""Registered profile queries: stats record, missing values, duplicates,
size, info, schema, describe, head, value counts, drops."""

from __future__ import annotations


from ..operators import profile as P
from . import oracle as O
from .inputs import oracle_from
from .registry import T, register, stats_view


def _stats_sql(t: str, name: str) -> str:
    return f"""{oracle_from(t) if t in ('dirty_orders',) else ''}
select '{name}' as filename, cast(count(*) as bigint) as rows, {len(O.cols(t))} as columns,
       {O.str_list(O.cols(t))} as columns_list, {O.str_list(O.numeric(t))} as numeric_columns,
       {O.str_list(O.non_numeric(t))} as categorical_columns,
       cast({O.missing_total(t)} as bigint) as missing_cells,
       round(coalesce(({O.missing_total(t)}) * 100.0 / (count(*) * {len(O.cols(t))}), 0), 2) as missing_pct,
       cast(({O.duplicates(t)}) as bigint) as duplicate_rows,
       round(({O.size_total(t)}) / 1024, 1) as memory_kb
from {t}"""


@register("stats_lineitem", _stats_sql("lineitem", "lineitem.parquet"))
def stats_lineitem(spark, sf):
    return stats_view(P.dataset_stats(T(spark, sf, "lineitem"), "lineitem.parquet"))


@register("stats_dirty_orders", _stats_sql("dirty_orders", "dirty_orders.csv"))
def stats_dirty_orders(spark, sf):
    return stats_view(P.dataset_stats(T(spark, sf, "dirty_orders"), "dirty_orders.csv"))


def _missing_sql(t: str, where: str = "") -> str:
    parts = [f"select {i} as ordinal, '{c}' as \"column\", count(*) filter (where {O.missing(c, ty)}) as missing from {t}"
             for i, (c, ty) in enumerate(O.SCHEMAS[t])]
    return f"{oracle_from(t)}select * from ({O.union_all(parts)}) m {where}"


@register("missing_counts", _missing_sql("dirty_orders"))
def missing_counts(spark, sf):
    return P.missing_counts(T(spark, sf, "dirty_orders"))


@register("missing_sorted", _missing_sql("dirty_orders") + ' order by missing desc, "column"')
def missing_sorted(spark, sf):
    return P.missing_sorted(T(spark, sf, "dirty_orders"))


@register("missing_only", _missing_sql("dirty_orders", "where missing > 0"))
def missing_only(spark, sf):
    return P.missing_only(T(spark, sf, "dirty_orders"))


@register("duplicate_rows", f"{oracle_from('dirty_orders')}select cast(({O.duplicates('dirty_orders')}) as bigint) as duplicate_rows")
def duplicate_rows(spark, sf):
    return P.duplicate_count(T(spark, sf, "dirty_orders"))


@register("duplicate_documents", """
select cast(count(*) - (select count(*) from (select distinct text, lang, source, n_chars from documents)) as bigint)
       as duplicate_rows from documents""")
def duplicate_documents(spark, sf):
    """Documents equal in every column but the identifier."""
    return P.duplicate_count(T(spark, sf, "documents").drop("doc_id"))


@register("duplicate_groups", """
select text, lang, source, n_chars, count(*) as copies from documents
group by text, lang, source, n_chars having count(*) > 1""")
def duplicate_groups(spark, sf):
    return P.duplicate_groups(T(spark, sf, "documents").drop("doc_id"))


@register("logical_size", f"select cast({O.size_total('orders')} as bigint) as bytes, round(({O.size_total('orders')}) / 1024, 1) as memory_kb from orders")
def logical_size(spark, sf):
    return P.logical_size(T(spark, sf, "orders"))


@register("load_status", "select true as dataset_loaded, 'orders.parquet' as filename, count(*) as rows, 6 as columns from orders")
def load_status(spark, sf):
    return P.load_status(T(spark, sf, "orders"), "orders.parquet")


def _info_sql(t: str) -> str:
    parts = [f"select {i} as ordinal, '{c}' as \"column\", count(*) filter (where not {O.missing(c, ty)}) as non_null, '{ty}' as dtype from {t}"
             for i, (c, ty) in enumerate(O.SCHEMAS[t])]
    return oracle_from(t) + O.union_all(parts)


@register("info_orders", _info_sql("dirty_orders"))
def info_orders(spark, sf):
    return P.info(T(spark, sf, "dirty_orders"))


def describe_numeric_sql(t: str, cols: list[str] | None = None) -> str:
    types = dict(O.SCHEMAS[t])
    pos = {c: i for i, (c, _) in enumerate(O.SCHEMAS[t])}
    parts = []
    for c in (cols if cols is not None else O.numeric(t)):
        parts.append(f"""select {pos[c]} as ordinal, '{c}' as "column", count(v) as count, round(avg(v), 4) as mean,
  round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(quantile_cont(v, 0.25), 4) as p25,
  round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, round(max(v), 4) as max
from (select {O.clean(c, types[c])} as v from {t})""")
    return oracle_from(t) + O.union_all(parts) if t not in ("lineitem", "orders", "part") else O.union_all(parts)


@register("describe_numeric", describe_numeric_sql("lineitem"))
def describe_numeric(spark, sf):
    return P.describe_numeric(T(spark, sf, "lineitem"), exact=True)


def describe_categorical_sql(t: str, cols: list[str]) -> str:
    pos = {c: i for i, (c, _) in enumerate(O.SCHEMAS[t])}
    vc = O.union_all([f"select {pos[c]} as ordinal, '{c}' as c, cast({O.q(c)} as varchar) as value, count(*) as n "
                      f"from {t} where {O.q(c)} is not null group by {O.q(c)}" for c in cols])
    return f"""{oracle_from(t) if t in O.SCHEMAS and t not in ('documents', 'lineitem', 'orders') else ''}
with vc as ({vc}),
r as (select *, row_number() over (partition by c order by n desc, value) as rn from vc)
select ordinal, c as "column", cast(sum(n) as bigint) as count, count(*) as unique,
       max(case when rn = 1 then value end) as top, max(case when rn = 1 then n end) as freq
from r group by ordinal, c"""


@register("describe_categorical", describe_categorical_sql("documents", ["text", "lang", "source"]))
def describe_categorical(spark, sf):
    return P.describe_categorical(T(spark, sf, "documents"))


def describe_datetime_sql(t: str, c: str, ordinal: int) -> str:
    ts = lambda e: f"make_timestamp(cast(floor({e}) as bigint))"
    return f"""
with s as (select epoch_us({O.q(c)}) as v from {t}),
m as (select min(v) as mn from s)
select {ordinal} as ordinal, '{c}' as "column", count(v) as count,
       make_timestamp(cast(min(m.mn) + sum(v - m.mn) // count(v) as bigint)) as mean,
       {ts('min(v)')} as min, {ts('quantile_cont(v, 0.25)')} as p25, {ts('quantile_cont(v, 0.5)')} as p50,
       {ts('quantile_cont(v, 0.75)')} as p75, {ts('max(v)')} as max
from s, m"""


@register("describe_datetime", describe_datetime_sql("lineitem", "l_shipdate", 10))
def describe_datetime(spark, sf):
    return P.describe_datetime(T(spark, sf, "lineitem"))


@register("head_orders", "select * from orders order by o_orderkey limit 5")
def head_orders(spark, sf):
    return P.sample_head(T(spark, sf, "orders"), 5, ["o_orderkey"])


@register("value_counts_part_brand", """
select p_brand, count(*) as count from part where p_brand is not null
group by p_brand order by count desc, p_brand limit 15""")
def value_counts_part_brand(spark, sf):
    return P.value_counts(T(spark, sf, "part"), "p_brand", 15)


@register("drop_missing_one", oracle_from("dirty_orders")
          + "select * from dirty_orders where o_totalprice is not null and not isnan(o_totalprice)")
def drop_missing_one(spark, sf):
    return P.drop_missing(T(spark, sf, "dirty_orders"), ["o_totalprice"])


@register("drop_missing_any", oracle_from("dirty_orders")
          + "select * from dirty_orders where o_totalprice is not null and not isnan(o_totalprice)"
            " and o_orderpriority is not null")
def drop_missing_any(spark, sf):
    return P.drop_missing(T(spark, sf, "dirty_orders"), ["o_totalprice", "o_orderpriority"])


def describe_all_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    pos = {c: i for i, (c, _) in enumerate(O.SCHEMAS[t])}
    nulls_num = "null::double as mean, null::double as std, null::double as min, null::double as p25, " \
                "null::double as p50, null::double as p75, null::double as max"
    nulls_cat = "null::bigint as unique, null::varchar as top, null::bigint as freq"
    nulls_ts = ", ".join(f"null::varchar as {c}_ts" for c in ("mean", "min", "p25", "p50", "p75", "max"))
    parts = []
    for c in O.numeric(t):
        v = O.clean(c, types[c])
        parts.append(f"""select {pos[c]} as ordinal, '{c}' as "column", count(v) as count, {nulls_cat},
  round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min,
  round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50,
  round(quantile_cont(v, 0.75), 4) as p75, round(max(v), 4) as max, {nulls_ts}
from (select {v} as v from {t})""")
    for c in O.categorical(t):
        parts.append(f"""select {pos[c]}, '{c}', cast(sum(n) as bigint), count(*), arg_min(value, (-n, value)), max(n),
  {', '.join(['null::double'] * 7)}, {', '.join(['null::varchar'] * 6)}
from (select {O.q(c)} as value, count(*) as n from {t} where {O.q(c)} is not null group by 1)""")
    fmt = "'%Y-%m-%d %H:%M:%S.%f'"
    for c in O.datetimes(t):
        ts = lambda e: f"strftime(make_timestamp(cast(floor({e}) as bigint)), {fmt})"
        parts.append(f"""select {pos[c]}, '{c}', count(v), null::bigint, null::varchar, null::bigint,
  {', '.join(['null::double'] * 7)},
  strftime(make_timestamp(cast(sum(v) // count(v) as bigint)), {fmt}), {ts('min(v)')}, {ts('quantile_cont(v, 0.25)')},
  {ts('quantile_cont(v, 0.5)')}, {ts('quantile_cont(v, 0.75)')}, {ts('max(v)')}
from (select epoch_us({O.q(c)}) as v from {t})""")
    return oracle_from(t) + O.union_all(parts)


@register("describe_all", describe_all_sql("dirty_orders"))
def describe_all(spark, sf):
    return P.describe(T(spark, sf, "dirty_orders"))


@register("numeric_projection", "select " + ", ".join(O.numeric("lineitem")) + " from lineitem")
def numeric_projection(spark, sf):
    """The numeric columns of lineitem."""
    return P.select_numeric(T(spark, sf, "lineitem"))


@register("non_numeric_projection", "select " + ", ".join(O.non_numeric("lineitem")) + " from lineitem")
def non_numeric_projection(spark, sf):
    """Every column that is not numeric."""
    return P.select_non_numeric(T(spark, sf, "lineitem"))


@register("info_summary", f"""
select dtype, count(*) as columns, (select cast({O.size_total('orders')} as bigint) from orders) as bytes,
       (select round(({O.size_total('orders')}) / 1024, 1) from orders) as memory_kb,
       (select count(*) from orders) as rows
from (values {', '.join(f"('{ty}')" for _, ty in O.SCHEMAS['orders'])}) t(dtype) group by dtype""")
def info_summary(spark, sf):
    """A7 totals: columns per dtype, rows and logical size."""
    return P.info_summary(T(spark, sf, "orders"))


@register("stats_pages", _stats_sql("pages", "pages.parquet"))
def stats_pages(spark, sf):
    """Stats record over whole HTML pages (sizes, duplicates of full texts)."""
    return stats_view(P.dataset_stats(T(spark, sf, "pages"), "pages.parquet"))


@register("describe_boolean", oracle_from("text_orders") + """
select 6 as ordinal, 'o_flag' as "column", count(b) as count, count(distinct b) as unique,
       arg_min(cast(b as varchar), (-n, cast(b as varchar))) as top, max(n) as freq
from (select b, count(*) over (partition by b) as n
      from (select case when o_flag in ('true', 'false') then o_flag = 'true' end as b from text_orders))
where b is not null""")
def describe_boolean(spark, sf):
    """A boolean column (inferred from text) described by frequencies."""
    from ..sources.readers import infer_types, normalize_missing
    typed = infer_types(normalize_missing(T(spark, sf, "text_orders")))
    return P.describe_categorical(typed, cols=["o_flag"])
