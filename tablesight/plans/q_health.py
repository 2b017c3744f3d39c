"""Registered health, problem-type and model-advice queries (H1-H8)."""

from __future__ import annotations

from ..operators import health as H
from . import oracle as O
from .inputs import oracle_from
from .registry import T, register


@register("health_missing", oracle_from("dirty_orders") + O.union_all([
    f"""select * from (select '{c}' as "column", round(count(*) filter (where {O.missing(c, ty)}) * 1.0 / count(*), 4) as missing_ratio
    from dirty_orders) where missing_ratio > 0.05""" for c, ty in O.SCHEMAS["dirty_orders"]]).replace(
    "select * from (", "select *, case when missing_ratio > 0.5 then 'severe' else 'warning' end as severity from ("))
def health_missing(spark, sf):
    return H.health_missing(T(spark, sf, "dirty_orders"))


@register("health_skew", oracle_from("skewed") + O.union_all([
    f"""select '{c}' as "column", round(skewness({O.clean(c, ty)}), 4) as skewness from skewed
    having var_samp({O.clean(c, ty)}) > 0 and abs(skewness({O.clean(c, ty)})) > 1"""
    for c, ty in O.SCHEMAS["skewed"]]))
def health_skew(spark, sf):
    return H.health_skew(T(spark, sf, "skewed"))


@register("health_cardinality", O.union_all([
    f"""select * from (select '{c}' as "column", count(distinct {c}) as "distinct",
       round(count(distinct {c}) * 1.0 / count({c}), 4) as distinct_ratio from documents)
    where "distinct" > 50 or distinct_ratio > 0.5""" for c in O.categorical("documents")]))
def health_cardinality(spark, sf):
    return H.health_cardinality(T(spark, sf, "documents"))


@register("health_leakage", oracle_from("leaky") + O.union_all([
    f"""select * from (select '{c}' as "column", 'abs_corr' as measure,
       round(abs(covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b))), 4) as value
       from (select case when {c} is not null and o_totalprice is not null then cast({c} as double) end as a,
                    case when {c} is not null and o_totalprice is not null then o_totalprice end as b from leaky))
    where value >= 0.95""" for c in O.numeric("leaky") if c != "o_totalprice"]))
def health_leakage(spark, sf):
    return H.health_leakage(T(spark, sf, "leaky"), "o_totalprice")


_PRICED = "select l_extendedprice as y, 'q' || cast(cast(l_quantity as int) as {text}) as code, l_returnflag as flag from {lineitem}"


@register("health_leakage_category", "with d as (" + _PRICED.format(text="varchar", lineitem="lineitem") + """),
m as (select avg(y) as mean, count(*) as n, sum((y - (select avg(y) from d)) ** 2) as total from d),
g as (select 'code' as "column", count(*) as n, avg(y) as a from d group by code union all select 'flag', count(*), avg(y) from d group by flag),
b as (select "column", count(*) as k, sum(n * (a - (select mean from m)) ** 2) as between_ from g group by 1)
select "column", 'correlation_ratio' as measure, round(sqrt(greatest(1 - (1 - between_ / total) * (n - 1) / (n - k), 0)), 4) as value from b, m""")
def health_leakage_category(spark, sf):
    """How far categories determine a numeric target (no threshold)."""
    df = spark.sql(_PRICED.replace("{text}", "string"), lineitem=T(spark, sf, "lineitem"))
    return H.health_leakage(df, "y", corr=0.0)


def _shares_sql(t: str, target: str, share: float) -> str:
    feats = [(c, ty) for c, ty in O.SCHEMAS[t] if c != target]
    parts = []
    for c, ty in feats:
        parts.append(f"""select * from (
  select '{c}' as "column", 'majority_share' as measure, round(sum(m) * 1.0 / sum(s), 4) as value
  from (select max(n) as m, sum(n) as s from
         (select cast({c} as varchar) as v, cast({target} as varchar) as tv, count(*) as n from {t} group by 1, 2)
        group by v))
where value >= {share} and '{c}' not in (select c from ids)""")
    ids = O.union_all([f"select '{c}' as c from {t} having count(distinct {c}) * 1.0 / count(*) >= 0.5"
                       for c, _ in feats])
    return oracle_from(t) + f", ids as ({ids})\n" + O.union_all(parts)


@register("health_leakage_shares", _shares_sql("classification", "quality", 0.0))
def health_leakage_shares(spark, sf):
    """Majority-target share of every non-identifier feature (no threshold)."""
    return H.health_leakage(T(spark, sf, "classification"), "quality", share=0.0)


def _information_sql(t: str, target: str) -> str:
    kinds = {c: ty for c, ty in O.SCHEMAS[t]}
    ranked = {c: f"epoch_us({c})::double" if ty.startswith(("timestamp", "date")) else f"{c}::double"
              for c, ty in kinds.items() if ty not in ("varchar", "string")}
    probs = ", ".join(str(i / 16) for i in range(1, 16))
    edges = ", ".join(f"quantile_cont({v}, [{probs}]) as e_{c}" for c, v in ranked.items())
    coded = ", ".join(f"cast(len(list_filter(e_{c}, lambda e: e < {ranked[c]})) as varchar) as {c}" if c in ranked else c for c in kinds)
    counts = O.union_all([f"select '{c}' as c, {c} as x, {target} as y, count(*) as n from coded group by all" for c in kinds if c != target])
    return f"""with edges as (select {edges} from {t}), coded as (select {coded} from {t}, edges),
cells as ({counts}),
own as (select c, x, sum(n) as nx from cells group by c, x), tgt as (select {target} as y, count(*) as ny from coded group by 1),
total as (select count(*) as rows, (select count(*) from tgt) as ky from coded),
h as (select -sum(ny / rows * ln(ny / rows)) as hy from tgt, total),
m as (select cells.c, sum(n / rows * ln(n * rows / (nx * ny))) as mi, count(*) as kxy
      from cells join own on cells.c = own.c and cells.x is not distinct from own.x join tgt on cells.y is not distinct from tgt.y, total group by cells.c),
k as (select c, count(*) as kx from own group by c)
select m.c as "column", round(greatest(mi, 0), 4) as mutual_information,
       round(least(greatest((mi - (kxy - kx - ky + 1) / (2.0 * rows)) / hy, 0), 1), 4) as share
from m join k on m.c = k.c, h, total where kx / rows < 0.5"""


@register("health_information", _information_sql("lineitem", "l_extendedprice"))
def health_information(spark, sf):
    """How much of the price's entropy each column of ``lineitem`` tells (no threshold)."""
    return H.health_information(T(spark, sf, "lineitem"), "l_extendedprice", share=0.0)


@register("health_report", oracle_from("dirty_orders") + """
select 'missing' as "check", "column", missing_ratio as value,
       case when missing_ratio > 0.5 then 'severe' else 'warning' end as severity
from (select 'o_totalprice' as "column", round(count(*) filter (where o_totalprice is null or isnan(o_totalprice)) * 1.0 / count(*), 4) as missing_ratio from dirty_orders
      union all select 'o_orderpriority', round(count(*) filter (where o_orderpriority is null) * 1.0 / count(*), 4) from dirty_orders)
where missing_ratio > 0.05
union all
select * from (select 'skewed', c, round(s, 4), 'warning' from (
  select 'o_orderkey' as c, skewness(o_orderkey) as s from dirty_orders union all
  select 'o_custkey', skewness(o_custkey) from dirty_orders union all
  select 'o_totalprice', skewness(case when isnan(o_totalprice) then null else o_totalprice end) from dirty_orders)
  where abs(s) > 1)
union all
select * from (select 'high_cardinality', c, cast(d as double), 'warning' from (
  select 'o_orderstatus' as c, count(distinct o_orderstatus) as d, count(o_orderstatus) as n from dirty_orders union all
  select 'o_orderpriority', count(distinct o_orderpriority), count(o_orderpriority) from dirty_orders)
  where d > 50 or d * 1.0 / n > 0.5)""")
def health_report(spark, sf):
    return H.health_report(T(spark, sf, "dirty_orders"))


@register("summary_facts", """
select * from (values ('rows', (select cast(count(*) as varchar) from orders)), ('columns', '6'),
  ('n_datetime', '1'), ('n_numeric', '3'), ('n_text', '2'),
  ('first_timestamp', (select cast(min(o_orderdate) as varchar) from orders)),
  ('last_timestamp', (select cast(max(o_orderdate) as varchar) from orders))) t(fact, value)""")
def summary_facts(spark, sf):
    return H.summary_facts(T(spark, sf, "orders"))


def _ptype_sql(t: str, target: str, numeric: bool, ts: list[str]) -> str:
    ts_like = " or ".join(f"count(distinct {c}) >= count(*) * 0.9" for c in ts) or "false"
    return f"""select '{target}' as target,
  case when {'false' if numeric else 'true'} or count(distinct {target}) <= 20 then 'classification'
       when {ts_like} then 'time-series' else 'regression' end as problem_type,
  count(distinct {target}) as target_distinct,
  case when {'false' if numeric else 'true'} or count(distinct {target}) <= 20 then count(distinct {target}) end as n_classes,
  count(*) as rows from {t}"""


@register("problem_types", oracle_from("classification") + O.union_all([
    _ptype_sql("classification", "quality", True, []),
    _ptype_sql("lineitem", "l_extendedprice", True, ["l_shipdate"]),
    _ptype_sql("events", "value", True, ["ts"]),
    _ptype_sql("documents", "lang", False, []),
    "select null as target, 'clustering' as problem_type, null as target_distinct, null as n_classes, count(*) as rows from embeddings"]))
def problem_types(spark, sf):
    out = H.problem_type(T(spark, sf, "classification"), "quality")
    for t, tgt in [("lineitem", "l_extendedprice"), ("events", "value"), ("documents", "lang"), ("embeddings", None)]:
        out = out.unionByName(H.problem_type(T(spark, sf, t), tgt))
    return out


@register("recommend_models", oracle_from("classification") + """
select problem_type, model, cast(row_number() over (partition by problem_type order by pos) as integer) as rank
from (values ('classification', 'Random Forest', 0, 2, null, 50), ('classification', 'Boosted Trees', 1, 2, 2, 200),
             ('classification', 'Decision Tree', 2, 3, null, 0), ('classification', 'Logistic Regression', 3, 2, null, 0)
     ) m(problem_type, model, pos, lo, hi, least_rows),
     (select count(distinct quality) as k, count(*) as n from classification) c
where (lo is null or c.k >= lo) and (hi is null or c.k <= hi) and c.n >= least_rows""")
def recommend_models(spark, sf):
    return H.recommend_models(T(spark, sf, "classification"), "quality")
