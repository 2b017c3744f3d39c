"""Exact distributed quantiles against numpy (linear interpolation), for
from values and from counted values."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tablesight.operators.quantiles import quantiles, quantiles_from_counts


@pytest.mark.parametrize("how", [10_000, 100, 20, (2_000_000, 1 << 40), (2_000_000, 0), (50, 0)])
def test_quantiles_match_numpy(spark, how):
    """An accuracy (small ones make narrow brackets), or the limits of the
    form that starts from counts."""
    rng = np.random.default_rng(3)
    data = []
    for g in range(3):
        vals = np.round(rng.exponential(10, 400), 1)  # repeated values
        data += [(g, float(v)) for v in vals]
    data += [(3, 5.0)]  # single value group
    df = spark.createDataFrame(data, "column int, value double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = {r["column"]: r["quantiles"] for r in
           (quantiles(df, probs, keys=["column"], accuracy=how) if isinstance(how, int) else
            quantiles_from_counts(df.groupBy("column", F.col("value").alias("v")).agg(F.count("*").alias("n")), probs, ["column"], how[0],
                                  one_task_bytes=how[1])).collect()}
    for g in range(4):
        ref = np.quantile(np.array([v for k, v in data if k == g]), probs)
        assert got[g] == pytest.approx(list(ref), abs=1e-9)


def test_hot_value_group(spark):
    # one value holding most rows: still one row per distinct value inside
    data = [(0, 1.0)] * 3000 + [(0, float(i)) for i in range(2, 200)]
    df = spark.createDataFrame(data, "column int, value double")
    got = quantiles(df, [0.5, 0.99], keys=["column"], accuracy=50).collect()[0]["quantiles"]
    ref = np.quantile(np.array([v for _, v in data]), [0.5, 0.99])
    assert got == pytest.approx(list(ref))


def skewed_groups(rng):
    groups = [np.round(rng.exponential(10, 3000), 2), np.r_[np.full(2000, 4.0), rng.normal(size=1000)], rng.integers(0, 3, 1500).astype(float),
              np.r_[rng.normal(size=500), np.full(200, np.inf), np.full(100, -np.inf)]]
    return groups, [(g, float(x)) for g, vals in enumerate(groups) for x in vals]


@pytest.mark.parametrize("shift", [0.0, 0.07, -0.07, 2.0])
def test_missed_brackets_are_ranked_again(spark, monkeypatch, shift):
    """Brackets put beside the wanted ranks, or beyond all values: the counts
    show it and the values between brackets are ranked."""
    from tablesight.operators import quantiles as Q
    ends = Q._ends
    monkeypatch.setattr(Q, "_ends", lambda probs, accuracy: [min(1.0, max(0.0, x + shift)) for x in ends(probs, accuracy)])
    groups, data = skewed_groups(np.random.default_rng(8))
    df = spark.createDataFrame(data, "column int, value double").repartition(7)
    probs = [0.5, 0.05, 0.95, 0.5, 0.0, 1.0]
    got = {r["column"]: r["quantiles"] for r in quantiles(df, probs, keys=["column"], accuracy=100).collect()}
    for g, vals in enumerate(groups):
        ordered = np.sort(vals)
        for p, x in zip(probs, got[g]):
            lo, hi = ordered[int(np.floor((len(vals) - 1) * p))], ordered[int(np.ceil((len(vals) - 1) * p))]
            frac = (len(vals) - 1) * p % 1
            assert x == (lo if lo == hi else pytest.approx(lo + (hi - lo) * frac))


def test_one_row_a_value(spark):
    """A value is counted once, however many probabilities are asked for."""
    df = spark.range(100_000).selectExpr("0 as column", "cast(id as double) as value")
    plan = quantiles(df, [0.1, 0.25, 0.5, 0.75, 0.9], keys=["column"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan.split("percentile_approx")[-1]
    assert quantiles(df, [0.5], keys=["column"]).first()["quantiles"] == [49999.5]
