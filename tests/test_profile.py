"""Unit tests on the literal frames of FIXTURES.md §3 (nulls, NaN, inf,
ties, constants, empty, one row, nested) against expected values."""

import datetime as dt
import math
import operator
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesight.functions.columns import non_numeric_columns, numeric_columns
from tablesight.operators import charts as G
from tablesight.operators import profile as P
from tablesight.operators import report as R


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mixed_classes_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, dt.datetime(2024, 1, 1), "x"), (2, float("nan"), False, dt.datetime(2024, 1, 2), None),
         (3, 2.0, True, dt.datetime(2024, 1, 3), "y")],
        "i bigint, f double, b boolean, t timestamp, s string")
    st = rows(P.dataset_stats(df, "mixed"))[0]
    assert st["missing_cells"] == 2
    assert numeric_columns(df) == ["i", "f"] and non_numeric_columns(df) == ["b", "t", "s"]
    assert list(st["numeric_columns"]) == ["i", "f"]
    assert st["missing_pct"] == round(2 / 15 * 100, 2)


def test_nan_duplicates_and_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,)], "a double")
    assert rows(P.duplicate_count(df))[0]["duplicate_rows"] == 1
    assert rows(P.missing_counts(df))[0]["missing"] == 2


def test_null_duplicates(spark):
    df = spark.createDataFrame([(None,), (None,)], "a string")
    assert rows(P.duplicate_count(df))[0]["duplicate_rows"] == 1


def test_top_ties_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "s string")
    r = rows(P.describe_categorical(df))[0]
    assert (r["top"], r["freq"], r["unique"], r["count"]) == ("a", 2, 2, 4)


def test_one_row_std_null(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    r = rows(P.describe_numeric(df))[0]
    assert r["std"] is None and r["p50"] == 1.0 and r["count"] == 1


def test_constant_corr_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "v double, w double")
    c = {(r["x"], r["y"]): r["corr"] for r in rows(G.correlation(df))}
    assert c[("v", "w")] is None and c[("w", "w")] == pytest.approx(1.0)


def test_pairwise_complete_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (None, 6.0, 1.0), (4.0, 8.5, 1.0)],
                               "a double, b double, k double")
    c = {(r["x"], r["y"]): r["corr"] for r in rows(G.correlation(df))}
    assert c[("a", "b")] == pytest.approx(0.999597, abs=1e-6)
    assert c[("b", "a")] == c[("a", "b")]
    assert c[("a", "k")] is None


def test_wide_corr_by_blocks(spark, monkeypatch):
    """Blocks of matrix products against fractions (doubles lose digits of the
    column far from zero): gaps, constants, far means,
    columns constant only where the other is present, infinite values."""
    from tablesight.operators import charts
    monkeypatch.setattr(charts, "GRAM_COLUMNS", 5)
    monkeypatch.setattr(charts, "GRAM_CELLS", 300)
    monkeypatch.setattr(charts, "REDO_PAIRS", 3)
    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame(rnd.normal(size=(400, 9)), columns=[f"c{i}" for i in range(9)])
    pdf["c1"] += pdf["c0"]
    pdf["c2"] = pdf["c0"] * 1e-3 + 1e9
    pdf["c3"] = 0.1
    pdf["c4"] = np.where(pdf.index < 200, 0.3, pdf["c4"])
    pdf["c5"] = np.where(pdf.index < 200, pdf["c5"], np.nan)
    pdf.loc[rnd.random(400) < 0.3, "c6"] = np.nan
    pdf["c7"] = np.nan
    pdf["c8"] = pdf["c8"] * 1e100

    def exact(x, y):
        both = pdf[[x, y]].dropna() if x != y else pdf[[x, x]].dropna()
        a, b = ([Fraction(v) for v in c] for c in (both.iloc[:, 0], both.iloc[:, 1]))

        def product(p, q):
            return float(len(a) * sum(map(operator.mul, p, q)) - sum(p) * sum(q))

        return product(a, b) / math.sqrt(product(a, a)) / math.sqrt(product(b, b))

    pdf["c9"] = np.where(pdf.index == 7, np.inf, pdf["c0"])
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)], ", ".join(f"{c} double" for c in pdf))
    got = rows(G.correlation(df.repartition(7)))
    assert len(got) == 100
    for r in got:
        if "c9" in (r["x"], r["y"]):
            continue
        const = {"c3", "c7"} & {r["x"], r["y"]} or {"c4", "c5"} == {r["x"], r["y"]}
        if const:
            assert r["corr"] is None, r
        else:
            assert r["corr"] == pytest.approx(exact(r["x"], r["y"]), abs=1e-11), r


def test_wide_corr_of_many_columns(spark):
    """No row is copied per pair: 140,715 pairs over a short table."""
    n = 530
    df = spark.range(40).selectExpr(*[f"sin(id * {k + 1}) AS c{k}" for k in range(n)])
    got = G.correlation(df)
    assert got.count() == n * n
    sample = np.sin(np.outer(np.arange(40), [1, 513, 530]))
    want = np.corrcoef(sample.T)
    pair = {(r["x"], r["y"]): r["corr"] for r in got.filter("x in ('c0', 'c512', 'c529') AND y in ('c0', 'c512', 'c529')").collect()}
    for a, x in enumerate(("c0", "c512", "c529")):
        for b, y in enumerate(("c0", "c512", "c529")):
            assert pair[x, y] == pytest.approx(want[a, b], abs=1e-9)


def test_infinite_not_missing(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,)], "v double")
    assert rows(P.missing_counts(df))[0]["missing"] == 0
    assert rows(R.report_numeric(df))[0]["infinite"] == 1


def test_adjusted_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert rows(R.report_moments(df))[0]["skewness"] == pytest.approx(1.7636326, abs=1e-6)
    df5 = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (4.0,)], "v double")
    assert rows(R.report_moments(df5))[0]["kurtosis"] == pytest.approx(3.152, abs=1e-3)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    h = sorted(rows(G.histogram(df, "v", 3)), key=lambda r: r["bin"])
    assert [r["count"] for r in h] == [1, 1, 2]
    assert h[0]["lower"] == 1.0 and h[-1]["upper"] == 4.0


def test_histogram_constant_widened(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    h = sorted(rows(G.histogram(df, "v", 2)), key=lambda r: r["bin"])
    assert h[0]["lower"] == 4.5 and h[-1]["upper"] == 5.5 and sum(r["count"] for r in h) == 2


def test_rounding_half_up(spark):
    df = spark.createDataFrame([(0.125,), (2.675,)], "v double")
    assert [r[0] for r in df.select(F.round("v", 2)).collect()] == [0.13, 2.68]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double")
    st = rows(P.dataset_stats(df, "empty"))[0]
    assert st["rows"] == 0 and st["missing_pct"] == 0 and st["duplicate_rows"] == 0
    d = rows(P.describe_numeric(df))[0]
    assert d["count"] == 0 and all(d[k] is None for k in ("mean", "std", "min", "p50", "max"))


def test_nested_duplicates(spark):
    df = spark.sql("select array(1, 2) as l, map('k', 1) as m, named_struct('x', 1) as r "
                   "union all select array(1, 2), map('k', 1), named_struct('x', 1)")
    assert rows(P.duplicate_count(df))[0]["duplicate_rows"] == 1
    assert rows(P.dataset_stats(df))[0]["duplicate_rows"] == 1


def test_value_counts_and_head(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), (None, 4)], "s string, k int")
    vc = rows(P.value_counts(df, "s", 15))
    assert vc == [{"s": "a", "count": 2}, {"s": "b", "count": 1}]
    assert [r["k"] for r in rows(P.sample_head(df, 2, ["k"]))] == [1, 2]


def test_describe_against_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.normal(size=500), "y": rng.integers(0, 50, 500).astype(float)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in rows(P.describe_numeric(df))}
    ref = pdf.describe()
    for c in ("x", "y"):
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(ref.loc[theirs, c], rel=1e-9, abs=1e-12)


def test_missing_total_is_sum(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", float("nan")), (None, None)], "s string, v double")
    per = sum(r["missing"] for r in rows(P.missing_counts(df)))
    assert per == rows(P.dataset_stats(df))[0]["missing_cells"] == 4


def test_datetime_describe(spark):
    df = spark.sql("select cast(t as timestamp_ntz) as t from values ('2024-01-01 00:00:00'), "
                   "('2024-01-03 00:00:00'), ('2024-01-04 00:00:00') as v(t)")
    r = rows(P.describe_datetime(df))[0]
    assert r["min"] == dt.datetime(2024, 1, 1) and r["max"] == dt.datetime(2024, 1, 4)
    assert r["p50"] == dt.datetime(2024, 1, 3)
    assert r["mean"] == dt.datetime(2024, 1, 2, 16, 0)
    assert not math.isnan(r["count"])


def test_shared_describe_matches_per_family(spark):
    from tablesight.functions.stats import round_doubles
    from tablesight.operators.shared import describe_shared
    df = spark.sql("""select * from values
        (1L, 2.5D, 'a', timestamp_ntz'2024-01-01 00:00:00', cast(null as double)),
        (2L, double('NaN'), 'b', timestamp_ntz'2024-01-03 12:00:00', cast(null as double)),
        (2L, 4.0D, 'a', cast(null as timestamp_ntz), cast(null as double))
        as t(k, x, s, ts, gone)""")
    P.describe(df, exact=False)  # approximate path builds too

    def rows_of(frame):
        return sorted(tuple(r) for r in round_doubles(frame).collect())

    from tablesight.operators.profile import describe_categorical, describe_datetime, describe_numeric
    shared = {r["column"]: r for r in describe_shared(df).collect()}
    assert shared["gone"]["count"] == 0 and shared["gone"]["mean"] is None
    assert shared["x"]["count"] == 2 and shared["x"]["mean"] == 3.25
    assert shared["s"]["top"] == "a" and shared["s"]["freq"] == 2
    assert shared["ts"]["mean_ts"] == "2024-01-02 06:00:00.000000"
    num = {r["column"]: r for r in describe_numeric(df).collect()}
    for c in ("k", "x"):
        for f in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"):
            a, b = shared[c][f], num[c][f]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (c, f, a, b)
    assert len(rows_of(describe_shared(spark.createDataFrame([], "a double")))) == 1


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1.0, "a", 2), (None, "b", 2), (3.0, "a", 5)], "`a.b` double, `x y` string, `q``t` int")
    assert P.dataset_stats(df).first()["missing_cells"] == 1
    d = {r["column"]: r for r in P.describe(df).collect()}
    assert d["a.b"]["mean"] == 2.0 and d["x y"]["top"] == "a" and d["q`t"]["max"] == 5.0
    assert {r["column"] for r in R.report_variables(df).collect()} == {"a.b", "x y", "q`t"}
    assert len(G.correlation(df).collect()) == 4
    assert sum(r["count"] for r in G.histogram(df, "a.b", 2).collect()) == 2
    assert {r["column"] for r in R.report_common_values(df).collect()} == {"a.b", "x y", "q`t"}


def test_approximate_paths(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    vals = rng.normal(100, 15, 2000)
    df = spark.createDataFrame([(float(v), f"c{int(v) % 40}") for v in vals], "x double, s string")
    d = P.describe_numeric(df, exact=False).first()
    assert abs(d["p50"] - np.median(vals)) < 2 and d["count"] == 2000
    q = R.report_quantiles(df, exact=False).first()
    assert abs(q["p95"] - np.quantile(vals, 0.95)) < 3
    m = R.report_mad(df, exact=False).first()
    assert abs(m["mad"] - np.median(np.abs(vals - np.median(vals)))) < 2
    v = {r["column"]: r["distinct"] for r in R.report_variables(df, exact=False).collect()}
    assert abs(v["s"] - 40) <= 2
    t = P.describe_datetime(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t"), exact=False).first()
    assert t["count"] == 1


def test_interval_class(spark):
    df = spark.sql("select * from values (interval '1' day), (interval '3' hour), (null) as t(d)")
    r = P.describe_interval(df).first()
    assert (r["count"], r["missing"]) == (2, 1)
    assert r["min"] == "INTERVAL '0 03' DAY TO HOUR" and r["max"] == "INTERVAL '1 00' DAY TO HOUR"
    assert P.schema_table(df).first()["class"] == "interval"
