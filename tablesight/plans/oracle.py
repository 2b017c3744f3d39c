"""Helpers that write the independent SQL (oracle) text for registered
queries. They only produce SQL strings; the oracle engine runs them.

Column lists of the driver tables and derived inputs are fixed here so the
SQL can be generated without touching data.
"""

from __future__ import annotations

# Schemas of the driver tables and derived inputs.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
}
SCHEMAS["dirty_orders"] = SCHEMAS["orders"]
SCHEMAS["pair_a"] = SCHEMAS["orders"]
SCHEMAS["pair_b"] = [("o_orderkey", "bigint"), ("o_custkey", "string"), ("o_orderstatus", "string"),
                     ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_half", "double")]
SCHEMAS["skewed"] = [("event_id", "bigint"), ("x", "double")]
SCHEMAS["constant"] = SCHEMAS["part"] + [("k", "double")]
SCHEMAS["leaky"] = SCHEMAS["orders"] + [("leak", "double")]
SCHEMAS["classification"] = [("doc_id", "bigint"), ("n_chars", "bigint"), ("lang", "string"),
                             ("source", "string"), ("quality", "int"), ("toxic", "int")]
SCHEMAS["regression"] = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
                         ("l_discount", "double"), ("l_tax", "double"), ("l_extendedprice", "double")]
SCHEMAS["text_orders"] = [(c, "string") for c in ("o_orderkey", "o_custkey", "o_orderstatus",
                          "o_totalprice", "o_orderdate", "o_orderpriority", "o_flag")]

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")
WIDTH = {"int": 4, "bigint": 8, "double": 8, "float": 4, "timestamp_ntz": 8, "boolean": 1}


def cols(t: str) -> list[str]:
    return [c for c, _ in SCHEMAS[t]]


def numeric(t: str) -> list[str]:
    return [c for c, ty in SCHEMAS[t] if ty in NUMERIC]


def non_numeric(t: str) -> list[str]:
    return [c for c, ty in SCHEMAS[t] if ty not in NUMERIC]


def categorical(t: str) -> list[str]:
    return [c for c, ty in SCHEMAS[t] if ty in ("string", "boolean") or ty.startswith("array")]


def datetimes(t: str) -> list[str]:
    return [c for c, ty in SCHEMAS[t] if ty.startswith("timestamp") or ty == "date"]


def q(c: str) -> str:
    return '"' + c + '"'


def missing(c: str, ty: str) -> str:
    return f"({q(c)} is null or isnan({q(c)}))" if ty in ("double", "float") else f"({q(c)} is null)"


def clean(c: str, ty: str) -> str:
    """NaN-free double value of a numeric column."""
    if ty in ("double", "float"):
        return f"(case when isnan({q(c)}) then null else cast({q(c)} as double) end)"
    return f"cast({q(c)} as double)"


def missing_total(t: str) -> str:
    return " + ".join(f"count(*) filter (where {missing(c, ty)})" for c, ty in SCHEMAS[t])


def size_total(t: str) -> str:
    fixed = sum(WIDTH.get(ty, 0) for _, ty in SCHEMAS[t])
    var = [f"coalesce(sum(strlen({q(c)})), 0)" for c, ty in SCHEMAS[t] if ty == "string"]
    return " + ".join([f"count(*) * {fixed}"] + var)


def duplicates(t: str) -> str:
    return f"(select count(*) from {t}) - (select count(*) from (select distinct * from {t}))"


def str_list(xs: list[str]) -> str:
    return "'" + ",".join(xs) + "'"


def union_all(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def rewrite_round(sql: str, digits: int = 4) -> str:
    """Rewrite every ``round(<expr>, 4)`` into the engine-independent
    ``floor((<expr>) * 10000 + 0.5) / 10000`` used on the Spark side."""
    out, i, key = [], 0, "round("
    low = sql.lower()
    while True:
        j = low.find(key, i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + len(key):k - 1]
        if comma >= 0 and sql[comma + 1:k - 1].strip() == str(digits):
            expr = rewrite_round(sql[j + len(key):comma], digits)
            m = 10 ** digits
            out.append(sql[i:j] + f"(floor(({expr}) * {m}.0 + 0.5) / {m}.0)")
        else:
            out.append(sql[i:j] + "round(" + rewrite_round(inner, digits) + ")")
        i = k
