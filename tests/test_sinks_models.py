"""Sinks (profile text, HTML page, chat exports), model saving, health
checks and report alerts on small frames."""

import glob
import os

from pyspark.ml import PipelineModel

from tablesight.operators import health as H
from tablesight.operators import ml as ML
from tablesight.operators import profile_text as PT
from tablesight.operators import report as R
from tablesight.sources import sinks as K


def read_parts(path, pattern="part-*"):
    out = []
    for p in sorted(glob.glob(os.path.join(path, pattern))):
        with open(p) as f:
            out.append(f.read())
    return "".join(out)


def test_profile_text_and_html(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (2, None, "b")], "k long, v double, s string")
    lines = PT.profile_text_lines(df, ["k"])
    K.write_profile_text(lines, os.path.join(tmpdir_path, "txt"))
    text = read_parts(os.path.join(tmpdir_path, "txt"))
    assert text.index("--- Dataset Info ---") < text.index("--- Missing Values ---") < \
        text.index("--- Statistical Summary ---") < text.index("--- Sample Data (first 5 rows) ---")
    assert "v 2" in text and "s count=3 unique=2 top=b freq=2" in text
    K.write_report_html(PT.report_html(df), os.path.join(tmpdir_path, "html"))
    html = read_parts(os.path.join(tmpdir_path, "html"))
    assert html.startswith("<html>") and html.rstrip().endswith("</html>") and "duplicates" in html


def test_chat_export_files(spark, tmpdir_path):
    conv = spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", "hello")],
                                 "conv_id long, turn long, role string, text string")
    K.write_chat_exports(conv, os.path.join(tmpdir_path, "md"))
    text = read_parts(os.path.join(tmpdir_path, "md", "conv_id=7"))
    assert text.rstrip("\n") == "# AI Mentor Chat Export\n\n---\n\n## You\n\nhi\n\n---\n\n## AI Mentor\n\nhello"


def test_train_save_and_reload(spark, tmpdir_path):
    rows = [(i, float(i % 7), "a" if i % 3 else "b", int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y int")
    model, pred = ML.train(df, "Random Forest", "y", split_key="id")
    path = os.path.join(tmpdir_path, "model")
    ML.save_model(model, path)
    again = PipelineModel.load(path)
    assert again.transform(df).count() == 120
    m = {r["metric"]: r["value"] for r in ML.evaluate(pred, "classification").collect()}
    assert m["accuracy"] == 1  # y depends on x alone


def test_train_summary_per_split(spark):
    import datetime as dt
    rows = [(i, float(i % 11), "ab"[i % 2], dt.datetime(2024, 1 + i % 12, 1), int(i % 11 > 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, c string, t timestamp, y int")
    for model in ("Logistic Regression", "Decision Tree", "SVM"):
        got = {(r["split"], r["metric"]): (r["rows"], r["value"]) for r in ML.train_summary(df, model, "", split_key="id").collect()}
        assert got["train", "accuracy"][0] + got["test", "accuracy"][0] == 300
        majority = max(sum(r[4] for r in rows), sum(1 - r[4] for r in rows)) / 300
        assert got["train", "accuracy"][1] > majority and got["test", "accuracy"][1] > majority
    assert ML.infer_target(df, "id") == "y" and "id" not in ML._prepare(df, None, "y", "id")


def test_clusters_ignore_the_key(spark):
    df = spark.createDataFrame([(i * 1000, float(i % 2) * 50) for i in range(200)], "id long, x double")
    _, pred = ML.train(df, "K-Means", None, split_key="id", clusters=2)
    sizes = [r["count"] for r in pred.groupBy("prediction").count().collect()]
    assert sorted(sizes) == [100, 100]


def test_health_and_alerts(spark):
    rows = [(i, float(i) if i % 4 else None, "k", float(i) * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double, c string, leak double")
    hm = {r["column"]: r["severity"] for r in H.health_missing(df).collect()}
    assert hm == {"v": "warning"}
    lk = {r["column"] for r in H.health_leakage(df, "leak").collect()}
    assert lk == {"id", "v"}
    al = {(r["column"], r["alert"]) for r in R.report_alerts(df).collect()}
    assert ("c", "constant") in al and ("id", "unique") in al and ("v", "missing") in al
    pt = H.problem_type(df, "c").first()
    assert pt["problem_type"] == "classification" and pt["n_classes"] == 1
    assert H.problem_type(df).first()["problem_type"] == "clustering"


def test_split_bucket_of_all_integers(spark):
    """Against plain integers, at the ends of the range too and with salts."""
    from pyspark.sql import functions as F
    from tablesight.operators import prep as M
    keys = [0, 1, -1, 7, 65535, 65536, 2**31, 2**32 - 1, 2**32, -2**32 - 5, 2**63 - 1, -2**63, 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for salt in (0, 3, 2**40 + 1, -9):
        got = df.select("k", M.split_bucket("k", salt, df.schema["k"].dataType).alias("b")).collect()
        assert [r["b"] for r in got] == [(k + salt) * M.KNUTH % 2**32 % 10000 for k in keys] + [None]
    b = M.split_bucket("k", 0, df.schema["k"].dataType)
    assert "decimal" not in df.select(b)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.select(F.max(M.split_bucket("k"))).first()[0] < 10000


def test_summary_predicts_each_row_once(spark, monkeypatch):
    """the metrics of each split ran the forest again, twice a row."""
    from tablesight.operators import ml as ML
    rows = [(i, i % 13 / 13, i % 7 * 1.0 + i % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    seen, plain = [], ML.regression_metrics
    monkeypatch.setattr(ML, "regression_metrics", lambda part: seen.append(part._jdf.queryExecution().optimizedPlan().toString()) or plain(part))
    got = {(r["split"], r["metric"]): r["value"] for r in ML.train_summary(df, "Random Forest", "y", split_key="id", kind="regression").collect()}
    assert len(seen) == 2 and not any("UDF" in plan for plan in seen)
    pred = ML.train(df, "Random Forest", "y", split_key="id", kind="regression")[1]
    for which in ("train", "test"):
        for r in plain(pred.filter(f"split = '{which}'")).collect():
            assert abs(got[which, r["metric"]] - r["value"]) < 1e-9
