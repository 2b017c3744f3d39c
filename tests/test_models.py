"""Training: categories of many values, words, a kernel machine, clusters that
choose their number, and ranking metrics against plain counting."""

import math
import os
import random

import pytest
from pyspark.ml import PipelineModel

from tablesight.operators import ml as ML


def metrics(pred, kind="classification", which="test"):
    return {r["metric"]: r["value"] for r in ML.evaluate(pred, kind, which).collect()}


@pytest.mark.parametrize("model", ["Logistic Regression", "Random Forest", "Neural Network (MLP)"])
def test_a_category_of_200_values_decides(spark, model):
    rnd = random.Random(1)
    label = {i: rnd.randint(0, 1) for i in range(200)}
    df = spark.createDataFrame([(i, f"code{i % 200}", rnd.random(), label[i % 200]) for i in range(4000)], "id long, code string, x double, y int")
    _, pred = ML.train(df, model, "y", split_key="id")
    assert metrics(pred)["accuracy"] > (0.95 if model != "Random Forest" else 0.6)


def test_words_of_long_texts_decide(spark, monkeypatch):
    monkeypatch.setattr(ML, "HASH_SLOTS", 1 << 13)
    rnd = random.Random(2)
    rows = []
    for i in range(1500):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(12)] + (["signal"] if i % 2 else ["other"])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "id long, t string, y int")
    _, pred = ML.train(df, "Logistic Regression", "y", split_key="id")
    assert metrics(pred)["accuracy"] > 0.95
    assert ML.train(df, "Decision Tree", "y", split_key="id")[1].count() == 1500  # leaves the texts out


def test_circle_in_ring(spark, tmpdir_path):
    rnd = random.Random(3)
    rows = []
    for i in range(800):
        r, a = (rnd.uniform(0, 1) if i % 2 else rnd.uniform(1.6, 2.6)), rnd.uniform(0, 2 * math.pi)
        rows.append((i, r * math.cos(a), r * math.sin(a), i % 2))
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model, pred = ML.train(df, "SVM", "y", split_key="id")
    assert metrics(pred)["accuracy"] > 0.95
    path = os.path.join(tmpdir_path, "svm")
    ML.save_model(model, path)
    again = PipelineModel.load(path).transform(df)
    assert again.filter("prediction = y").count() > 0.95 * 800


def test_clusters_choose_their_number(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.gauss(20 * (i % 4), 1), rnd.gauss(-20 * (i % 2), 1), "abcd"[i % 4]) for i in range(400)], "id long, a double, b double, c string")
    for model in ("K-Means", "Gaussian Mixture"):
        _, pred = ML.train(df, model, None, split_key="id")
        assert pred.select("prediction").distinct().count() == 4 and metrics(pred, "clustering")["silhouette"] > 0.7


def test_one_cluster_has_a_defined_result(spark):
    df = spark.createDataFrame([(i, 1.0, "k") for i in range(60)], "id long, a double, c string")
    for model in ("K-Means", "Gaussian Mixture"):
        got = ML.train_summary(df, model, None, split_key="id").collect()
        assert [r["value"] for r in got] == [None, None]


def plain(rows):
    pos, neg = [x for y, x in rows if y == 1], [x for y, x in rows if y == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, tp, fp = 0.0, 0, 0
    for x in sorted({x for _, x in rows}, reverse=True):
        at = [y for y, v in rows if v == x]
        tp, fp = tp + sum(at), fp + len(at) - sum(at)
        ap += sum(at) / max(len(pos), 1) * tp / (tp + fp)
    loss = -sum(math.log(min(max(x if y else 1 - x, 1e-15), 1 - 1e-15)) for y, x in rows) / len(rows)
    return auc, ap if pos and neg else None, loss


@pytest.mark.parametrize("parts", [1, 7])
def test_ranking_metrics(spark, parts):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(500)]
    rows = [(y, min(1.0, x + .2) if y else x) for y, x in rows]
    odd = [(None, .5), (2, .5), (1, None), (0, float("nan"))]
    got = ML.ranking_metrics(spark.createDataFrame([(y, x) for y, x in rows + odd], "label int, score double"), partitions=parts)
    got = {r["metric"]: r["value"] for r in got.collect()}
    for name, want in zip(("roc_auc", "pr_auc", "log_loss"), plain(rows)):
        assert got[name] == pytest.approx(want)


def test_ranking_metrics_edges(spark):
    get = lambda rows: [r["value"] for r in ML.ranking_metrics(spark.createDataFrame(rows, "label int, score double")).collect()]
    assert get([(1, .5), (1, .7)])[:2] == [None, None] and get([]) == [None] * 3
    assert get([(1, 3.0), (0, -1.0)]) == [1.0, 1.0, None]
