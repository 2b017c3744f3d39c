"""Registered feature and preparation queries (F1-F8, M1-M4)."""

from __future__ import annotations


from ..operators import features as X
from ..operators import prep as M
from .inputs import oracle_from
from .registry import T, register


@register("feat_ratio", """
select l_orderkey, l_linenumber, round(case when l_quantity <> 0 then l_extendedprice / l_quantity end, 4)
       as l_extendedprice_per_l_quantity from lineitem""")
def feat_ratio(spark, sf):
    return X.ratio(T(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_extendedprice_per_l_quantity")


@register("feat_log1p", oracle_from("skewed") + "select event_id, round(case when x >= 0 then ln(1 + x) end, 4) as log1p_x from skewed")
def feat_log1p(spark, sf):
    return X.log1p(T(spark, sf, "skewed"), ["x"]).select("event_id", "log1p_x")


@register("feat_date_parts", """
select event_id, cast(year(ts) as int) as ts_year, cast(month(ts) as int) as ts_month,
       cast((dayofweek(ts) + 6) % 7 as int) as ts_dow, cast(hour(ts) as int) as ts_hour from events""")
def feat_date_parts(spark, sf):
    return X.date_parts(T(spark, sf, "events"), "ts").select("event_id", "ts_year", "ts_month", "ts_dow", "ts_hour")


@register("feat_bins", """
select l_orderkey, l_linenumber,
       cast(least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) as int) as l_extendedprice_bin
from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)""")
def feat_bins(spark, sf):
    return X.bins(T(spark, sf, "lineitem"), "l_extendedprice", 10).select(
        "l_orderkey", "l_linenumber", "l_extendedprice_bin")


@register("feat_quantile_bins", """
select o_orderkey, cast(len(list_filter(cuts, lambda c: c <= o_totalprice)) as int) as o_totalprice_bin
from orders, (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as cuts from orders)""")
def feat_quantile_bins(spark, sf):
    return X.bins(T(spark, sf, "orders"), "o_totalprice", 5, method="quantile").select(
        "o_orderkey", "o_totalprice_bin")


@register("feat_frequency", "select o_orderkey, count(*) over (partition by o_custkey) as o_custkey_freq from orders")
def feat_frequency(spark, sf):
    return X.frequency_encode(T(spark, sf, "orders"), "o_custkey").select("o_orderkey", "o_custkey_freq")


@register("feat_missing_flag", oracle_from("dirty_orders") + """
select *, cast(o_totalprice is null or isnan(o_totalprice) as int) as o_totalprice_missing,
       cast(o_orderpriority is null as int) as o_orderpriority_missing from dirty_orders""")
def feat_missing_flag(spark, sf):
    return X.missing_flags(T(spark, sf, "dirty_orders"), ["o_totalprice", "o_orderpriority"])


@register("feat_group_relative", """
select o_orderkey, round(o_totalprice - avg(o_totalprice) over (partition by o_orderstatus), 4)
       as o_totalprice_minus_o_orderstatus_mean from orders""")
def feat_group_relative(spark, sf):
    return X.group_relative(T(spark, sf, "orders"), "o_orderstatus", "o_totalprice").select(
        "o_orderkey", "o_totalprice_minus_o_orderstatus_mean")


@register("feat_candidates")
def feat_candidates(spark, sf):
    """Rule-based feature suggestions for lineitem (rows-only check)."""
    return X.feature_candidates(T(spark, sf, "lineitem"))


@register("impute", oracle_from("dirty_orders") + """
select cast(o_orderkey as double) as o_orderkey, cast(o_custkey as double) as o_custkey,
       coalesce(o_orderstatus, (select o_orderstatus from dirty_orders where o_orderstatus is not null
                                group by 1 order by count(*) desc, 1 limit 1)) as o_orderstatus,
       round(case when o_totalprice is null or isnan(o_totalprice)
             then (select avg(case when isnan(o_totalprice) then null else o_totalprice end) from dirty_orders)
             else o_totalprice end, 4) as o_totalprice,
       o_orderdate,
       coalesce(o_orderpriority, (select o_orderpriority from dirty_orders where o_orderpriority is not null
                                  group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority
from dirty_orders""")
def impute(spark, sf):
    return M.impute(T(spark, sf, "dirty_orders"), "mean")


@register("impute_median", oracle_from("dirty_orders") + """
select o_orderkey, o_custkey, o_orderstatus,
       round(coalesce(case when isnan(o_totalprice) then null else o_totalprice end,
                      (select quantile_cont(o_totalprice, 0.5) from dirty_orders where not isnan(o_totalprice))), 4) as o_totalprice,
       o_orderdate, o_orderpriority
from dirty_orders""")
def impute_median(spark, sf):
    return M.impute(T(spark, sf, "dirty_orders"), "median", cols=["o_totalprice"])


@register("encode_index", """
select "column", value, cast(row_number() over (partition by "column" order by n desc, value) - 1 as double) as index,
       n as count
from (select 'p_brand' as "column", p_brand as value, count(*) as n from part group by p_brand
      union all select 'p_type', p_type, count(*) from part group by p_type)""")
def encode_index(spark, sf):
    return M.category_index(T(spark, sf, "part"), ["p_brand", "p_type"])


@register("encode_columns", """
select p_partkey,
       cast(row_number() over (partition by 1 order by 1) * 0 as double) * 0 + bi.idx as p_brand_index
from part join (select p_brand, cast(row_number() over (order by count(*) desc, p_brand) - 1 as double) as idx
                from part group by p_brand) bi using (p_brand)""".replace(
    "cast(row_number() over (partition by 1 order by 1) * 0 as double) * 0 + ", ""))
def encode_columns(spark, sf):
    return M.encode_index(T(spark, sf, "part"), ["p_brand"]).select("p_partkey", "p_brand_index")


@register("scale", """
select l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over (), 4) as l_quantity_scaled,
       round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_samp(l_extendedprice) over (), 4) as l_extendedprice_scaled,
       round((l_discount - avg(l_discount) over ()) / stddev_samp(l_discount) over (), 4) as l_discount_scaled
from lineitem""")
def scale(spark, sf):
    return M.scale(T(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select(
        "l_orderkey", "l_linenumber", "l_quantity_scaled", "l_extendedprice_scaled", "l_discount_scaled")


@register("split", """
select o_orderkey, case when ((o_orderkey::hugeint * 2654435761) % 4294967296) % 10000 < 2000
                        then 'test' else 'train' end as split from orders""")
def split(spark, sf):
    return M.split(T(spark, sf, "orders"), "o_orderkey", 0.2).select("o_orderkey", "split")


@register("encode_one_hot")
def encode_one_hot(spark, sf):
    """M2 one-hot encoding of part brands and types (vectors: rows-only)."""
    return M.one_hot(T(spark, sf, "part"), ["p_brand", "p_type"]).select("p_partkey", "p_brand_onehot", "p_type_onehot")
