"""k-nearest neighbours: exact search against brute force, classification,
the query-size check, and search among all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import neighbors as N


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 0.3, (30, 4)), rng.normal(5, 0.3, (30, 4))])
    rows = [(i, [float(x) for x in p], int(i >= 30)) for i, p in enumerate(pts)]
    return pts, spark.createDataFrame(rows, "id long, embedding array<double>, label int")


def test_knn_matches_brute_force(spark, vectors):
    pts, df = vectors
    q = df.filter("id in (0, 45)").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in N.knn(q, df, 3, exclude_self=True).collect()}
    for qi in (0, 45):
        d = np.sqrt(((pts - pts[qi]) ** 2).sum(axis=1))
        d[qi] = np.inf
        assert [got[(qi, r)] for r in (1, 2, 3)] == list(np.argsort(d, kind="stable")[:3])


def test_knn_classify_and_size_check(spark, vectors):
    _, df = vectors
    q = df.filter("id in (3, 40)").withColumnRenamed("id", "query_id")
    pred = {r["query_id"]: r["prediction"] for r in N.knn_classify(q, df, 5).collect()}
    assert pred == {3: 0, 40: 1}
    with pytest.raises(ValueError, match="max_queries"):
        N.knn(df.withColumnRenamed("id", "query_id"), df, 3, max_queries=10)


def brute(x, k, self_too=False):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if not self_too:
        np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["id"])
    return np.mean([len(got.get(i, set()) & set(w)) / len(w) for i, w in enumerate(want)])


def test_knn_approx_on_clustered_vectors(spark):
    """Many small clusters: few pairs are compared, nearly all neighbours found."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(120, 12)) * 5)[:, None, :] + rng.normal(size=(120, 10, 12)) * .3
    x = x.reshape(-1, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    hashing, share = N.fit_hashing(x, 5)
    assert hashing.projections and share < 0.25
    assert recall(N.knn_approx(df, 5).collect(), brute(x, 5)) >= 0.9


def test_knn_approx_on_the_embeddings(spark):
    """Vectors about as far from all others: recall stays, all pairs if need be."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact = N.knn(e.withColumnRenamed("id", "query_id"), e, 5, exclude_self=True).collect()
    want = {}
    for r in exact:
        want.setdefault(r["query_id"], set()).add(r["id"])
    found = 0
    for r in N.knn_approx(e, 5).collect():
        found += r["id"] in want[r["query_id"]]
    assert found >= 0.9 * len(exact)


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 0)
    x = np.repeat(np.arange(300.0)[:, None] // 3, 2, axis=1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in N.knn_join(df, df, 4, "id", "id", hashing=N.Hashing(0, 1.0)).collect())
    want = brute(x, 4, self_too=True)
    assert [g[2] for g in got] == want.ravel().tolist() and len(got) == 1200
    assert N.knn_join(df.limit(0), df, 2, "id", "id").collect() == [] and N.knn_join(df, df.limit(0), 2, "id", "id").collect() == []


def test_knn_as_a_model(spark):
    from tablesight.operators import ml as ML
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(3 * (i % 3), .3)), "ab"[i % 3 == 1], f"c{i % 3}") for i in range(400)] + [(900, None, None, "c0")]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    _, pred = ML.train(df, "K-Nearest Neighbors", "y", split_key="id")
    m = {r["metric"]: r["value"] for r in ML.evaluate(pred, "classification").collect()}
    assert m["accuracy"] > 0.95 and pred.count() == 401
    _, pred = ML.train(df.selectExpr("id", "c", "x as y", "y as k"), "K-Nearest Neighbors", "y", split_key="id", kind="regression")
    assert {r["metric"]: r["value"] for r in ML.evaluate(pred, "regression").collect()}["r2"] > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_nearest_is_exact(seed, monkeypatch):
    """Copies, near copies, far clusters, odd numbers and few rows against brute
    force in double precision, in parts of one row and of many."""
    monkeypatch.setattr(N, "PART", [1, 4 << 20][seed % 2])
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 8))
    clusters = rng.normal(size=(3, 8))[rng.integers(0, 3, 300)] * 1e4 + rng.normal(size=(300, 8)) * 1e-4
    for y in (base, clusters, base * 1e-100, base[:3], np.repeat(base[:40], 9, axis=0), np.vstack([base[:1] + rng.normal(size=(200, 8)) * 1e-9, base]),
              np.vstack([base, np.full((2, 8), np.nan), np.full((1, 8), np.inf), np.zeros((4, 8))])):
        x = y[np.isfinite(y).all(1)][::3]
        places, away = N.nearest(x, y, 6)
        d = ((x[:, None] - y[None]) ** 2).sum(2)
        want = np.argsort(d, axis=1, kind="stable")[:, :6]
        assert (places == want).all() and (away == np.take_along_axis(d, want, 1)).all()


def test_nearest_of_odd_vectors_and_none():
    y = np.arange(20.0).reshape(10, 2)
    places, away = N.nearest(np.array([[np.nan, 1.0], [4.0, 5.0]]), y, 3)
    assert places.tolist() == [[0, 1, 2], [2, 1, 3]] and np.isnan(away[0]).all() and away[1].tolist() == [0, 8, 8]
    assert N.nearest(y, y[:0], 3)[0].shape == (10, 0) and N.nearest(y[:0], y, 3)[0].shape == (0, 3)


def test_cells_must_spare_work():
    """Pairs that meet in several tables are compared in each: cells that hold
    nearly everything are more work than an exact search."""
    x = np.random.default_rng(3).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert N.fit_hashing(x, 5) == (N.Hashing(0, 1.0), 1.0)


def test_nearest_does_not_sort_all_distances(monkeypatch):
    """the block comparison sorted every distance of a block."""
    monkeypatch.setattr(N, "_by_sorting", None)
    x = np.random.default_rng(5).normal(size=(2000, 64))
    assert (N.nearest(x, x, 2)[0][:, 0] == np.arange(2000)).all()


def test_repeated_and_null_ids_crowd_nobody_out(spark):
    """Rows three times, one id of many vectors, null ids: five others each, at the least distance to any row of an id."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 3 + [(7, (x[8] + rng.normal(size=3) * .001).tolist()) for _ in range(30)] + [(None, x[9].tolist())] * 9
    got = N.knn_approx(spark.createDataFrame(rows, "id long, embedding array<double>"), 5).collect()
    away = {}
    for i, v in rows:
        for j, w in rows:
            if i is not None and j is not None and i != j:
                d = np.linalg.norm(np.subtract(v, w))
                away[i, j] = min(d, away.get((i, j), d))
    for i in range(40):
        want = sorted((away[i, j], j) for j in range(40) if j != i)[:5]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [j for _, j in want]
