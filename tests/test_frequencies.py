"""Frequencies by hash against plain counting: ties, long and unique texts,
and exchanges that carry no texts."""

import random
from collections import Counter

import pytest

from tablesight.operators import frequencies as Q
from tablesight.operators.profile import describe, describe_categorical
from tablesight.operators.report import report_common_values, report_variables

SCHEMA = "a string, b string, c double, value string"


def rows(seed, n=400):
    rnd = random.Random(seed)
    long = [("https://example.org/" + x * 30) for x in "abcdefgh"]
    return [(rnd.choice(["x", "y", "z", None]), rnd.choice(long) + (str(i) if i % 3 else ""), rnd.choice([1.0, float("nan"), None, 2.5]), f"unique text {i}")
            for i in range(n)]


def tops(data, i, k):
    n = Counter(r[i] for r in data if r[i] is not None and r[i] == r[i])
    return sorted(((str(v), c) for v, c in n.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("seed,limit", [(1, 500_000), (2, 0)])
def test_top_values(spark, monkeypatch, seed, limit):
    """Both ways of fetching the texts: candidates broadcast, and shuffled."""
    monkeypatch.setattr(Q, "MAX_BROADCAST", limit)
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    for k in (1, 3, 7):
        got = Q.top_values(df, Q.value_hashes(df), k).collect()
        for i in range(4):
            want = tops(data, i, k)
            assert [(r.value, r.n) for r in sorted(got, key=lambda r: r["rank"]) if r.ordinal == i] == want


def test_candidates_are_few(spark):
    """Of a column of unique texts only those that tie with the k-th head."""
    df = spark.range(5000).selectExpr("concat(lpad(id, 6, '0'), repeat('x', 500)) as a")
    assert Q.candidates(Q.value_hashes(df), 3).count() == 3


def test_describe_and_report(spark):
    data = rows(5)
    df = spark.createDataFrame(data, SCHEMA)
    for r in describe_categorical(df).collect():
        present = [x[r.ordinal] for x in data if x[r.ordinal] is not None]
        assert (r["count"], r["unique"]) == (len(present), len(set(present))) and (r.top, r.freq) == tops(data, r.ordinal, 1)[0]
    everything = {r.column: r for r in describe(df).collect()}
    assert everything["b"].top == tops(data, 1, 1)[0][0] and everything["c"]["count"] == sum(x[2] is not None and x[2] == x[2] for x in data)
    assert {r.column: r.distinct for r in report_variables(df).collect()} == {"a": 3, "b": len({x[1] for x in data}), "c": 2, "value": 400}
    common = report_common_values(df, 2).collect()
    assert [(r.value, r["count"]) for r in sorted(common, key=lambda r: r["rank"]) if r.column == "b"] == tops(data, 1, 2)


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)
    assert Q.top_values(df, Q.value_hashes(df), 2).collect() == []
    got = {r.column: (r["count"], r["unique"], r.top, r.freq) for r in describe_categorical(df).collect()}
    assert got == {c: (0, 0, None, None) for c in ("a", "b", "value")}
    assert [(r["count"], r.top) for r in describe_categorical(df.limit(0)).collect()] == [(0, None)] * 3
    assert report_variables(df.limit(0)).collect() == []


def test_no_exchange_carries_the_texts(spark, capsys):
    df = spark.createDataFrame(rows(1), SCHEMA)
    Q.grouped_hashes(df).explain()
    exchanged = [line for line in capsys.readouterr().out.split("\n") if "Exchange" in line]
    assert exchanged and all("head#" in line and "value#" not in line for line in exchanged)
