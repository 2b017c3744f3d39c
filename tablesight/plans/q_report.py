"""Registered profile-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from . import oracle as O
from .inputs import oracle_from
from .q_charts import hist_sql
from .registry import T, register

BASE = ("lineitem", "orders", "documents", "part", "events")


def _with(t: str) -> str:
    return "" if t in BASE else oracle_from(t)


def _pct(num: str, den: str) -> str:
    return f"round(cast({num} as double) * 100.0 / nullif({den}, 0), 4)"


@register("report_overview", f"""{oracle_from('dirty_orders')}
select 6 as variables, cast(count(*) as bigint) as observations,
       cast({O.missing_total('dirty_orders')} as bigint) as missing_cells,
       round(({O.missing_total('dirty_orders')}) * 100.0 / (count(*) * 6), 2) as missing_pct,
       cast(({O.duplicates('dirty_orders')}) as bigint) as duplicate_rows,
       round(cast(({O.duplicates('dirty_orders')}) as double) * 100.0 / count(*), 4) as duplicate_pct,
       round(({O.size_total('dirty_orders')}) / 1024, 1) as total_size_kb,
       round(round(({O.size_total('dirty_orders')}) / 1024, 1) * 1024.0 / count(*), 4) as avg_record_bytes,
       3 as n_numeric, 2 as n_text, 0 as n_boolean, 1 as n_datetime, 0 as n_nested, 0 as n_interval
from dirty_orders""")
def report_overview(spark, sf):
    return R.report_overview(T(spark, sf, "dirty_orders"))


def variables_sql(t: str) -> str:
    parts = []
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        present = f"not {O.missing(c, ty)}"
        parts.append(f"""select {i} as ordinal, '{c}' as "column",
  count(distinct {O.q(c)}) filter (where {present}) as "distinct",
  {_pct(f'count(distinct {O.q(c)}) filter (where {present})', f'count(*) filter (where {present})')} as distinct_pct,
  count(*) filter (where {O.missing(c, ty)}) as missing,
  {_pct(f'count(*) filter (where {O.missing(c, ty)})', 'count(*)')} as missing_pct
from {t}""")
    return O.union_all(parts)


@register("report_variables", oracle_from("dirty_orders") + variables_sql("dirty_orders"))
def report_variables(spark, sf):
    return R.report_variables(T(spark, sf, "dirty_orders"))


def numeric_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    parts = []
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        if c not in O.numeric(t):
            continue
        v = O.clean(c, types[c])
        parts.append(f"""select {i} as ordinal, '{c}' as "column",
  count(*) filter (where abs(v) = 'inf'::double) as infinite, {_pct("count(*) filter (where abs(v) = 'inf'::double)", 'count(*)')} as infinite_pct,
  count(*) filter (where v = 0) as zeros, {_pct('count(*) filter (where v = 0)', 'count(*)')} as zeros_pct,
  count(*) filter (where v < 0) as negative, {_pct('count(*) filter (where v < 0)', 'count(*)')} as negative_pct,
  round(min(v), 4) as min, round(max(v), 4) as max, round(avg(v), 4) as mean, round(sum(v), 2) as sum
from (select {v} as v from {t})""")
    return _with(t) + O.union_all(parts)


@register("report_numeric", numeric_sql("lineitem"))
def report_numeric(spark, sf):
    return R.report_numeric(T(spark, sf, "lineitem")).withColumn("sum", F.round("sum", 2))


def quantiles_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    parts = []
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        if c not in O.numeric(t):
            continue
        qs = ", ".join(f"round(quantile_cont(v, {p}), 4) as p{n}" for p, n in
                       [(0.05, 5), (0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95)])
        parts.append(f"""select {i} as ordinal, '{c}' as "column", {qs}, round(max(v) - min(v), 4) as range,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) as iqr
from (select {O.clean(c, types[c])} as v from {t})""")
    return _with(t) + O.union_all(parts)


@register("report_quantiles", quantiles_sql("lineitem"))
def report_quantiles(spark, sf):
    return R.report_quantiles(T(spark, sf, "lineitem"))


def moments_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    parts = []
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        if c not in O.numeric(t):
            continue
        parts.append(f"""select {i} as ordinal, '{c}' as "column", round(avg(v), 4) as mean,
  round(stddev_samp(v), 4) as std, round(var_samp(v), 4) as variance,
  round(stddev_samp(v) / nullif(avg(v), 0), 4) as cv,
  round(case when var_samp(v) > 0 then skewness(v) end, 4) as skewness,
  round(case when var_samp(v) > 0 then kurtosis(v) end, 4) as kurtosis
from (select {O.clean(c, types[c])} as v from {t})""")
    return _with(t) + O.union_all(parts)


@register("report_moments", moments_sql("lineitem"))
def report_moments(spark, sf):
    return R.report_moments(T(spark, sf, "lineitem"))


@register("report_moments_skewed", moments_sql("skewed"))
def report_moments_skewed(spark, sf):
    return R.report_moments(T(spark, sf, "skewed"))


def mad_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    parts = []
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        if c not in O.numeric(t):
            continue
        parts.append(f"""select {i} as ordinal, '{c}' as "column", round(m.med, 4) as median,
  round(quantile_cont(abs(s.v - m.med), 0.5), 4) as mad
from (select {O.clean(c, types[c])} as v from {t}) s,
     (select quantile_cont({O.clean(c, types[c])}, 0.5) as med from {t}) m
where s.v is not null group by m.med""")
    return _with(t) + O.union_all(parts)


@register("report_mad", mad_sql("lineitem"))
def report_mad(spark, sf):
    return R.report_mad(T(spark, sf, "lineitem"))


def common_sql(t: str, k: int) -> str:
    vc = O.union_all([f"select {i} as ordinal, '{c}' as \"column\", cast({O.q(c)} as varchar) as value, count(*) as n "
                      f"from {t} where not {O.missing(c, ty)} group by {O.q(c)}"
                      for i, (c, ty) in enumerate(O.SCHEMAS[t])])
    return f"""{_with(t)}select * from (
select ordinal, "column", cast(row_number() over (partition by ordinal, "column" order by n desc, value) as integer) as rank,
       value, n as count, round(n * 100.0 / (select count(*) from {t}), 4) as pct from ({vc})) where rank <= {k}"""


@register("report_common_values", common_sql("documents", 10))
def report_common_values(spark, sf):
    return R.report_common_values(T(spark, sf, "documents"), k=10)


def extremes_sql(t: str, k: int) -> str:
    types = dict(O.SCHEMAS[t])
    vc = O.union_all([f"select {i} as ordinal, '{c}' as \"column\", v as value, count(*) as n "
                      f"from (select {O.clean(c, types[c])} as v from {t}) where v is not null group by v"
                      for i, (c, ty) in enumerate(O.SCHEMAS[t]) if c in O.numeric(t)])
    return f"""{_with(t)}with vc as ({vc})
select * from (select ordinal, "column", 'min' as side, cast(row_number() over (partition by ordinal, "column" order by value) as integer) as rank,
       round(value, 4) as value, n as count from vc) where rank <= {k}
union all
select * from (select ordinal, "column", 'max' as side, cast(row_number() over (partition by ordinal, "column" order by value desc) as integer) as rank,
       round(value, 4) as value, n as count from vc) where rank <= {k}"""


@register("report_extremes", extremes_sql("lineitem", 5))
def report_extremes(spark, sf):
    return R.report_extremes(T(spark, sf, "lineitem"), k=5)


@register("report_histograms", hist_sql("lineitem", O.numeric("lineitem"), 30))
def report_histograms(spark, sf):
    return R.report_histograms(T(spark, sf, "lineitem"), bins=30)


@register("report_datetime", """
select 4 as ordinal, 'o_orderdate' as "column", min(o_orderdate) as min, max(o_orderdate) as max,
       epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate)) as range_micros from orders""")
def report_datetime(spark, sf):
    return R.report_datetime(T(spark, sf, "orders"))


def alerts_sql(t: str) -> str:
    cat = set(O.categorical(t))
    parts = [f"select '*' as \"column\", 'duplicates' as alert, cast(d as double) as value from (select ({O.duplicates(t)}) as d) where d > 0"]
    for i, (c, ty) in enumerate(O.SCHEMAS[t]):
        pres = f"not {O.missing(c, ty)}"
        dist = f"count(distinct {O.q(c)}) filter (where {pres})"
        npres = f"count(*) filter (where {pres})"
        miss = f"count(*) filter (where {O.missing(c, ty)})"
        parts.append(f"select '{c}', 'constant', cast({dist} as double) from {t} having {dist} = 1")
        parts.append(f"select '{c}', 'unique', round({dist} * 100.0 / {npres}, 4) from {t} having {dist} > 1 and {dist} = {npres}")
        parts.append(f"select '{c}', 'missing', {_pct(miss, 'count(*)')} from {t} having {miss} > 0")
        if c in cat:
            parts.append(f"select '{c}', 'high_cardinality', cast({dist} as double) from {t} having {dist} > 50")
        if c in O.numeric(t):
            v = O.clean(c, ty)
            parts.append(f"select '{c}', 'zeros', {_pct(f'count(*) filter (where {v} = 0)', 'count(*)')} from {t} "
                         f"having count(*) filter (where {v} = 0) * 100.0 / count(*) > 10")
            parts.append(f"select '{c}', 'infinite', {_pct(f'count(*) filter (where abs({v}) = {chr(39)}inf{chr(39)}::double)', 'count(*)')} "
                         f"from {t} having count(*) filter (where abs({v}) = 'inf'::double) > 0")
            parts.append(f"select '{c}', 'skewed', round(skewness({v}), 4) from {t} "
                         f"having var_samp({v}) > 0 and abs(skewness({v})) > 20")
    return _with(t) + O.union_all(parts)


@register("report_alerts", alerts_sql("constant"))
def report_alerts(spark, sf):
    return R.report_alerts(T(spark, sf, "constant"))


@register("report_alerts_dirty", alerts_sql("dirty_orders"))
def report_alerts_dirty(spark, sf):
    return R.report_alerts(T(spark, sf, "dirty_orders"))
