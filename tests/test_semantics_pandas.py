"""Semantics against pandas/numpy on the same small generated frames
(SURVEY §5): duplicates, correlation, histogram, value counts, compare."""

import numpy as np
import pandas as pd
import pytest

from tablesight.operators import charts as G
from tablesight.operators import compare as C
from tablesight.operators import profile as P


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "a": rng.integers(0, 5, n).astype(float),
        "b": rng.normal(0, 1, n).round(1),
        "s": rng.choice(["x", "y", "z", None], n),
    })
    pdf.loc[::13, "a"] = np.nan
    pdf.loc[::29, "b"] = np.nan
    pdf = pd.concat([pdf, pdf.iloc[:25]], ignore_index=True)  # exact duplicate rows
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, s string")
    return pdf, sdf


def test_duplicates_like_pandas(frames):
    pdf, sdf = frames
    assert P.duplicate_count(sdf).first()["duplicate_rows"] == int(pdf.duplicated().sum())


def test_corr_like_pandas(frames):
    pdf, sdf = frames
    ref = pdf[["a", "b"]].corr()
    got = {(r["x"], r["y"]): r["corr"] for r in G.correlation(sdf).collect()}
    assert got[("a", "b")] == pytest.approx(ref.loc["a", "b"], abs=1e-12)


def test_histogram_like_numpy(frames):
    pdf, sdf = frames
    counts, edges = np.histogram(pdf["b"].dropna(), bins=30)
    got = sorted(G.histogram(sdf, "b", 30).collect(), key=lambda r: r["bin"])
    assert [r["count"] for r in got] == list(counts)
    assert [r["lower"] for r in got] == pytest.approx(list(edges[:-1]))


def test_value_counts_like_pandas(frames):
    pdf, sdf = frames
    ref = pdf["s"].value_counts()
    got = {r["s"]: r["count"] for r in P.value_counts(sdf, "s", 15).collect()}
    assert got == {k: int(v) for k, v in ref.items()}


def test_compare_like_pandas(frames):
    pdf, sdf = frames
    half = sdf.filter("a is null or a < 3")
    ph = pdf[pdf["a"].isna() | (pdf["a"] < 3)]
    got = {r["column"]: r for r in C.compare_numeric(sdf, half).collect()}
    for c in ("a", "b"):
        assert got[c]["mean_1"] == pytest.approx(pdf[c].mean()) and got[c]["mean_2"] == pytest.approx(ph[c].mean())
        assert got[c]["std_2"] == pytest.approx(ph[c].std()) and got[c]["missing_2"] == int(ph[c].isnull().sum())
