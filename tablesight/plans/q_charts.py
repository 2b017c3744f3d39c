"""Registered chart aggregates: correlation matrix, histograms, pair grid."""

from __future__ import annotations

from ..operators import charts as G
from . import oracle as O
from .inputs import oracle_from
from .registry import T, register


def corr_sql(t: str) -> str:
    types = dict(O.SCHEMAS[t])
    cols = O.numeric(t)
    parts = []
    for x in cols:
        for y in cols:
            vx, vy = O.clean(x, types[x]), O.clean(y, types[y])
            parts.append(f"""select '{x}' as x, '{y}' as y, round(case when sx * sy > 0 then cxy / (sx * sy) end, 4) as corr
from (select covar_samp(a, b) as cxy, stddev_samp(a) as sx, stddev_samp(b) as sy
      from (select case when {vx} is not null and {vy} is not null then {vx} end as a,
                   case when {vx} is not null and {vy} is not null then {vy} end as b from {t}))""")
    return (oracle_from(t) if t not in ("lineitem", "orders") else "") + O.union_all(parts)


@register("corr_matrix", corr_sql("lineitem"))
def corr_matrix(spark, sf):
    return G.correlation(T(spark, sf, "lineitem"))


@register("corr_constant", corr_sql("constant"))
def corr_constant(spark, sf):
    """Correlation with a constant column gives null, not an error."""
    return G.correlation(T(spark, sf, "constant"))


def hist_sql(t: str, cols: list[str], bins: int) -> str:
    types = dict(O.SCHEMAS[t])
    parts = []
    for c in cols:
        v = O.clean(c, types[c])
        parts.append(f"""
select '{c}' as "column", g.bin, round(r.lo2 + g.bin * r.w, 4) as lower,
       round(case when g.bin = {bins - 1} then r.hi2 else r.lo2 + (g.bin + 1) * r.w end, 4) as upper,
       coalesce(k.n, 0) as count
from (select lo2, hi2, (hi2 - lo2) / {bins} as w from
        (select case when min(v) = max(v) then min(v) - 0.5 else min(v) end as lo2,
                case when min(v) = max(v) then max(v) + 0.5 else max(v) end as hi2
         from (select {v} as v from {t}) where v is not null)) r
cross join (select cast(unnest(range(0, {bins})) as integer) as bin) g
left join (select cast(least({bins - 1}, floor((v - lo2) / ((hi2 - lo2) / {bins}))) as integer) as bin, count(*) as n
           from (select {v} as v from {t}) s,
                (select case when min(v) = max(v) then min(v) - 0.5 else min(v) end as lo2,
                        case when min(v) = max(v) then max(v) + 0.5 else max(v) end as hi2
                 from (select {v} as v from {t}) where v is not null) rr
           where v is not null group by 1) k on k.bin = g.bin""")
    return (oracle_from(t) if t not in ("lineitem", "orders") else "") + O.union_all(parts)


@register("histogram_30", hist_sql("lineitem", ["l_extendedprice"], 30).replace("'l_extendedprice' as \"column\", ", ""))
def histogram_30(spark, sf):
    return G.histogram(T(spark, sf, "lineitem"), "l_extendedprice", 30)


@register("histograms_skewed", hist_sql("skewed", ["event_id", "x"], 30))
def histograms_skewed(spark, sf):
    return G.histograms(T(spark, sf, "skewed"), bins=30)


def pair_sql(t: str, k: int, bins: int) -> str:
    types = dict(O.SCHEMAS[t])
    cols = O.numeric(t)[:k]
    vals = ", ".join(f"{O.clean(c, types[c])} as v{i}" for i, c in enumerate(cols))
    notnull = " and ".join(f"v{i} is not null" for i in range(len(cols)))
    rng = ", ".join(f"min(v{i}) as lo{i}, max(v{i}) as hi{i}" for i in range(len(cols)))

    def b(i: int) -> str:
        lo = f"(case when lo{i} = hi{i} then lo{i} - 0.5 else lo{i} end)"
        hi = f"(case when lo{i} = hi{i} then hi{i} + 0.5 else hi{i} end)"
        return f"cast(least({bins - 1}, floor((v{i} - {lo}) / (({hi} - {lo}) / {bins}))) as integer)"
    binned = ", ".join(f"{b(i)} as b{i}" for i in range(len(cols)))
    parts = [f"select '{cols[i]}' as x, '{cols[j]}' as y, b{i} as bin_x, b{j} as bin_y from bb"
             for i in range(len(cols)) for j in range(len(cols))]
    return f"""with vv as (select * from (select {vals} from {t}) where {notnull}),
r as (select {rng} from vv),
bb as (select {binned} from vv, r)
select x, y, bin_x, bin_y, count(*) as n from ({O.union_all(parts)}) group by all"""


@register("pair_grid", pair_sql("lineitem", 5, 10))
def pair_grid(spark, sf):
    return G.pair_grid(T(spark, sf, "lineitem"), k=5, bins=10)


@register("scatter_points", """
select round(l_quantity, 4) as l_quantity, round(l_extendedprice, 4) as l_extendedprice from lineitem
where l_quantity is not null and l_extendedprice is not null
order by md5('42|' || l_orderkey || '|' || l_linenumber) limit 500""")
def scatter_points(spark, sf):
    """500 rows of lineitem, the same under any partitioning."""
    return G.scatter_sample(T(spark, sf, "lineitem"), n=500, cols=["l_quantity", "l_extendedprice"], keys=["l_orderkey", "l_linenumber"])
