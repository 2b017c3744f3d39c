"""Registered comparison queries (pair A: even order keys; pair B: odd keys
with one column dropped, one added and one changed to text)."""

from __future__ import annotations

from ..operators import compare as C
from . import oracle as O
from .inputs import oracle_from
from .registry import T, register

_A, _B = dict(O.SCHEMAS["pair_a"]), dict(O.SCHEMAS["pair_b"])


def _overlap_sql() -> str:
    rows = ([(c, "common", _A[c], _B[c]) for c in sorted(set(_A) & set(_B))]
            + [(c, "only_in_1", _A[c], None) for c in sorted(set(_A) - set(_B))]
            + [(c, "only_in_2", None, _B[c]) for c in sorted(set(_B) - set(_A))])
    lit = lambda v: "null::varchar" if v is None else f"'{v}'"
    # column names from the two inputs' schemas, as the oracle engine describes them
    return O.union_all([f"select '{c}' as \"column\", '{s}' as status, {lit(a)} as dtype_1, {lit(b)} as dtype_2"
                        for c, s, a, b in rows])


@register("column_overlap", _overlap_sql())
def column_overlap(spark, sf):
    return C.column_overlap(T(spark, sf, "pair_a"), T(spark, sf, "pair_b"))


def _compare_numeric_sql() -> str:
    cols = sorted(set(O.numeric("pair_a")) & set(O.numeric("pair_b")))[:12]
    parts = []
    for c in cols:
        a, b = O.clean(c, _A[c]), O.clean(c, _B[c])
        parts.append(f"""select '{c}' as "column",
  (select round(avg({a}), 4) from pair_a) as mean_1, (select round(avg({b}), 4) from pair_b) as mean_2,
  (select round(stddev_samp({a}), 4) from pair_a) as std_1, (select round(stddev_samp({b}), 4) from pair_b) as std_2,
  (select count(*) filter (where {O.missing(c, _A[c])}) from pair_a) as missing_1,
  (select count(*) filter (where {O.missing(c, _B[c])}) from pair_b) as missing_2""")
    return oracle_from("pair_a", "pair_b") + O.union_all(parts)


@register("compare_numeric", _compare_numeric_sql())
def compare_numeric(spark, sf):
    return C.compare_numeric(T(spark, sf, "pair_a"), T(spark, sf, "pair_b"), max_columns=12)


def _overview_sql() -> str:
    def side(t: str) -> dict[str, str]:
        n = len(O.cols(t))
        return {
            "rows": f"(select count(*) from {t})", "columns": str(n),
            "numeric": str(len(O.numeric(t))), "categorical": str(len(O.non_numeric(t))),
            "missing_cells": f"(select {O.missing_total(t)} from {t})",
            "missing_pct": f"(select round(coalesce(({O.missing_total(t)}) * 100.0 / (count(*) * {n}), 0), 2) from {t})",
            "duplicate_rows": f"({O.duplicates(t)})",
            "memory_kb": f"(select round(({O.size_total(t)}) / 1024, 1) from {t})",
        }
    a, b = side("pair_a"), side("pair_b")
    return oracle_from("pair_a", "pair_b") + O.union_all([
        f"select '{m}' as metric, cast({a[m]} as double) as value_1, cast({b[m]} as double) as value_2" for m in a])


@register("compare_overview", _overview_sql())
def compare_overview(spark, sf):
    return C.compare_overview(T(spark, sf, "pair_a"), T(spark, sf, "pair_b"))


_WIDE = [f"c{i:02d}" for i in range(1, 15)]


def _wide_sql() -> str:
    one = "select " + ", ".join(f"{{q}} * {i} as {c}" for i, c in enumerate(_WIDE, 1)) + " from lineitem where l_orderkey % 2 = {r}"
    sides = {"a": one.format(q="l_quantity", r=0), "b": one.format(q="l_tax", r=1)}
    parts = [f"""select '{c}' as "column", (select avg({c}) from a) as mean_1, (select avg({c}) from b) as mean_2,
  (select stddev_samp({c}) from a) as std_1, (select stddev_samp({c}) from b) as std_2,
  (select count(*) - count({c}) from a) as missing_1, (select count(*) - count({c}) from b) as missing_2""" for c in _WIDE[:12]]
    return "with " + ", ".join(f"{k} as ({v})" for k, v in sides.items()) + " " + " union all ".join(parts)


@register("compare_first_12", _wide_sql(), digits=None)
def compare_first_12(spark, sf):
    """Two inputs with 14 common numeric columns, of which 12 are shown."""
    li = T(spark, sf, "lineitem")
    a, b = (li.filter(f"l_orderkey % 2 = {r}").selectExpr(*[f"{q} * {i} as {c}" for i, c in enumerate(_WIDE, 1)])
            for q, r in (("l_quantity", 0), ("l_tax", 1)))
    return C.compare_numeric(a, b, max_columns=12)
