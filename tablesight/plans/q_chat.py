"""Registered conversation and ad-hoc queries."""

from __future__ import annotations

from ..operators import conversations as L
from ..operators.adhoc import DISPLAY_ROWS, adhoc
from .registry import T, register


@register("chat_recent", """
select conv_id, string_agg(upper(role) || ': ' || substring(text, 1, 400), chr(10) order by turn) as context
from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
where rn <= 6 group by conv_id""")
def chat_recent(spark, sf):
    return L.recent_context(T(spark, sf, "conversations"))


@register("chat_messages", """
select conv_id, -1::bigint as seq, 'system' as role, '' as content from (select distinct conv_id from conversations)
union all select conv_id, turn as seq, role, text as content from conversations""")
def chat_messages(spark, sf):
    return L.model_messages(T(spark, sf, "conversations"))


@register("chat_markdown", """
select conv_id, -1::bigint as seq, '# AI Mentor Chat Export' || chr(10) as block from (select distinct conv_id from conversations)
union all select conv_id, turn, '## ' || case when role = 'user' then 'You' else 'AI Mentor' end || chr(10) || chr(10)
                 || text || chr(10) from conversations""")
def chat_markdown(spark, sf):
    return L.markdown_blocks(T(spark, sf, "conversations"))


@register("chat_counts", "select conv_id, count(*) as messages from conversations group by conv_id")
def chat_counts(spark, sf):
    return L.message_counts(T(spark, sf, "conversations"))


@register("chat_reset", """
select c.conv_id, c.turn, c.role, c.text from conversations c
left join (select conv_id, max(turn) as r from conversations where role = 'system' group by conv_id) s using (conv_id)
where s.r is null or c.turn > s.r""")
def chat_reset(spark, sf):
    return L.since_reset(T(spark, sf, "conversations"))


@register("chat_append", """
with l as (select conv_id, max(turn) as m from conversations group by conv_id)
select conv_id, turn, role, text from conversations
union all select conv_id, m + 1, 'user', 'again' from l union all select conv_id, m + 2, 'assistant', 'ok' from l""")
def chat_append(spark, sf):
    conv = T(spark, sf, "conversations")
    new = conv.select("conv_id").distinct().selectExpr("conv_id", "inline(array(struct(1 as pos, 'assistant' as role, 'ok' as text), struct(0 as pos, 'user' as role, 'again' as text)))")
    return L.append_turns(conv, new)


@register("chat_messages_profile", """
select conv_id, -1::bigint as seq, 'system' as role, 'Be brief.' || chr(10) || chr(10) || 'Context — User''s Dataset Profile:' || chr(10) || 'rows: 3' as content
from (select distinct conv_id from conversations)
union all select conv_id, turn, role, text from conversations""")
def chat_messages_profile(spark, sf):
    return L.model_messages(T(spark, sf, "conversations"), "Be brief.", "rows: 3")


_ADHOC = """select o_orderstatus, count(*) as n, avg(o_totalprice) as avg_price, max(o_orderdate) as last_order
from {df} group by o_orderstatus order by n desc, o_orderstatus"""


@register("adhoc_sql", _ADHOC.replace("{df}", "orders") + " limit 50")
def adhoc_sql(spark, sf):
    return adhoc(spark, {"df": T(spark, sf, "orders")}, _ADHOC, limit=DISPLAY_ROWS)


_ADHOC_JOIN = """select c.c_mktsegment, n.n_name, count(*) as orders, sum(o.o_totalprice) as revenue
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
group by c.c_mktsegment, n.n_name order by revenue desc, c.c_mktsegment, n.n_name"""


@register("adhoc_join", _ADHOC_JOIN.replace("{orders}", "orders").replace("{customer}", "customer")
          .replace("{nation}", "nation") + " limit 50")
def adhoc_join(spark, sf):
    return adhoc(spark, {t: T(spark, sf, t) for t in ("orders", "customer", "nation")}, _ADHOC_JOIN, limit=DISPLAY_ROWS)
