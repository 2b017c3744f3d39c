"""Property tests: invariants over generated small frames."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablesight.operators import charts as G
from tablesight.operators import profile as P
from tablesight.operators import report as R

cell = st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False))
frames = st.lists(st.tuples(cell, cell), min_size=1, max_size=30)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(frames)
def test_histogram_counts_sum_to_present(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    present = sum(1 for a, _ in rows if a is not None and not math.isnan(a))
    h = G.histogram(df, "a", 7).collect()
    assert sum(r["count"] for r in h) == present
    assert len(h) == (7 if present else 0)


@SETTINGS
@given(frames)
def test_corr_symmetric_diagonal(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    c = {(r["x"], r["y"]): r["corr"] for r in G.correlation(df).collect()}
    assert c[("a", "b")] == c[("b", "a")]
    for k in ("a", "b"):
        assert c[(k, k)] is None or abs(c[(k, k)] - 1) < 1e-9
    if c[("a", "b")] is not None:
        assert -1 - 1e-9 <= c[("a", "b")] <= 1 + 1e-9


@SETTINGS
@given(frames)
def test_counts_add_up(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    st_ = P.dataset_stats(df).first()
    miss = sum(1 for r in rows for v in r if v is None or math.isnan(v))
    assert st_["missing_cells"] == miss
    var = {r["column"]: r for r in R.report_variables(df).collect()}
    for i, k in enumerate(("a", "b")):
        assert var[k]["missing"] == sum(1 for r in rows if r[i] is None or math.isnan(r[i]))
    assert st_["duplicate_rows"] == len(rows) - len({tuple("nan" if (v is not None and math.isnan(v)) else v
                                                           for v in r) for r in rows})


@SETTINGS
@given(frames)
def test_quartiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["column"]: r for r in P.describe_numeric(df).collect()}
    for i, k in enumerate(("a", "b")):
        vals = np.array([r[i] for r in rows if r[i] is not None and not math.isnan(r[i])])
        if len(vals) == 0:
            assert got[k]["p50"] is None
        else:
            ref = np.quantile(vals, [0.25, 0.5, 0.75])
            assert [got[k]["p25"], got[k]["p50"], got[k]["p75"]] == \
                [float(x) for x in ref] or np.allclose([got[k]["p25"], got[k]["p50"], got[k]["p75"]], ref)
