"""Embedding near-dedup against all pairs."""

import contextlib
import os
import threading

import numpy as np
import pytest

from tablesight.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.95):
    vectors = []
    for _, v in rows:
        good = v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0
        v = np.array(v, np.float32).astype(float) if good else None
        vectors.append(v / np.linalg.norm(v) if good else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            x, y = vectors[i], vectors[j]
            link[i, j] = i != j and x is not None and y is not None and len(x) == len(y) and rows[i][0] is not None \
                and rows[j][0] is not None and x @ y >= least
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in np.flatnonzero(link[i]))])
            changed |= low < label[i]
            label[i] = low
    out = []
    for i in range(n):
        members = [rows[j][0] for j in range(n) if label[j] == label[i]]
        comp = min(members) if rows[i][0] is not None else None
        out.append((rows[i][0], int(link[i].sum()), comp, rows[i][0] == comp))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted([tuple(r) for r in embeddings.near_duplicates(df).collect()], key=str)


def clusters(seed, n, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for size in (1, 2, 5, 60):
        for _ in range(n // size):
            c = rng.standard_normal(d)
            for _ in range(size):
                rows.append((len(rows), (c + rng.uniform(0.02, 0.3) * rng.standard_normal(d)).tolist()))
    return rows


def test_matches_all_pairs(spark):
    rows = clusters(1, 120)
    assert run(spark, rows) == brute(rows)


def test_many_leaves_blocks_and_recall(spark, monkeypatch):
    """Small leaves and blocks force deep trees and split leaves."""
    monkeypatch.setattr(embeddings, "LEAF", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = clusters(2, 240)
    want, got = brute(rows), run(spark, rows)
    total = sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.98 * total
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) > 0.97


def test_leaves_split_on_their_own_samples(spark, monkeypatch):
    """A sample too small for the table: leaves are split again in Spark, twice
    or more; copies too close to part stay together and are compared in blocks."""
    monkeypatch.setattr(embeddings, "SAMPLE", 64)
    monkeypatch.setattr(embeddings, "SPLIT", 60)
    monkeypatch.setattr(embeddings, "SPLIT_SAMPLE", 48)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    c = np.random.default_rng(5)
    center = c.standard_normal(24)
    rows = clusters(4, 300)
    rows += [(len(rows) + i, (center + 0.01 * c.standard_normal(24)).tolist()) for i in range(150)]
    want, got = brute(rows), run(spark, rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g for g, w in zip(got, want, strict=True) if w[0] >= len(rows) - 150] == [w for w in want if w[0] >= len(rows) - 150]


def test_double_vectors_keep_their_precision(spark):
    df = spark.createDataFrame([(1, [1.0, 1e-9]), (2, [1.0, 1e-9]), (3, [0.1, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, least_cosine=0.95).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [5.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.1]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1e-38, 0.0])]
    got, want = run(spark, rows), brute(rows)
    assert got == want


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.select("vec_id", "embedding").collect()]
    found, want = run(spark, rows), brute(rows, 0.95)
    assert sum(r[1] for r in found) >= 0.9 * sum(r[1] for r in want)
    with pytest.raises(AttributeError):
        embeddings.near_duplicates(None)


def test_ids_that_repeat(spark):
    """Rows of one id with other vectors, or with none, count for themselves."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (3, None), (4, [-1.0, 0.0]), (None, [1.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_passes_rounds_and_blocks_count_each_pair_once(spark, monkeypatch):
    """A few rows a pass, leaves split in several rounds, large leaves in blocks
    and a group whose members share earlier leaves: counts are those of all pairs."""
    for name, value in (("SAMPLE", 64), ("LEAF", 30), ("SPLIT", 60), ("SPLIT_SAMPLE", 64), ("BLOCK", 40), ("PASS_COPIES", 0.5), ("PASS_BYTES", 1)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    c = np.random.default_rng(8)
    center = c.standard_normal(24)
    rows = [(i, (center + 0.01 * c.standard_normal(24)).tolist()) for i in range(200)]
    rows += [(200 + i, v) for i, v in clusters(9, 240)]
    want, got = brute(rows), run(spark, rows)
    assert [g for g in got if g[0] < 200] == [w for w in want if w[0] < 200]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_disk_is_a_small_multiple_of_the_vectors(spark, monkeypatch):
    """Shuffle files and tables of a call, at their largest, however many leaves a vector is in."""
    monkeypatch.setattr(embeddings, "PASS_BYTES", 1 << 20, raising=False)
    n, d = 12_000, 64
    x = np.random.default_rng(3).standard_normal((n, d)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(4)
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def used():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.lstat(f"{at}/{name}").st_size
        return total

    start, most, done = used(), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], used() - start)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert embeddings.near_duplicates(df).count() == n
    finally:
        done.set()
        watcher.join()
    assert most[0] <= 4 * x.nbytes
