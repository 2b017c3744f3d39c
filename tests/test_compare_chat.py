"""Comparison properties, conversation operators (batch and streaming),
features and preparation."""

import os

from pyspark.sql import functions as F

from tablesight.operators import compare as C
from tablesight.operators import conversations as L
from tablesight.operators import features as X
from tablesight.operators import prep as M
from tablesight.streaming import message_counts_stream, recent_context_stream


def test_overlap_partitions_names(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, "2", 3.0)], "k int, v string, w double")
    ov = {r["column"]: r["status"] for r in C.column_overlap(a, b).collect()}
    assert ov == {"k": "common", "v": "common", "s": "only_in_1", "w": "only_in_2"}
    assert C.common_numeric(a, b) == ["k"]


def test_compare_same_table_equal_sides(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "k int, v double")
    for r in C.compare_numeric(a, a).collect():
        assert r["mean_1"] == r["mean_2"] and r["std_1"] == r["std_2"] and r["missing_1"] == r["missing_2"]
    for r in C.compare_overview(a, a).collect():
        assert r["value_1"] == r["value_2"]


def chat(spark):
    rows = [(1, t, "system" if t == 2 else ("user" if t % 2 == 0 else "assistant"),
             ("x" * 500) if t == 5 else f"message {t}") for t in range(8)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_recent_context_last_six_cut_at_400(spark):
    ctx = L.recent_context(chat(spark)).collect()[0]["context"].split("\n")
    assert len(ctx) == 6 and ctx[0] == "SYSTEM: message 2"
    assert ctx[3] == "ASSISTANT: " + "x" * 400


def test_markdown_headings(spark):
    b = {r["seq"]: r["block"] for r in L.markdown_blocks(chat(spark)).collect()}
    assert b[-1] == "# AI Mentor Chat Export\n"
    assert b[0].startswith("## You\n\n") and b[2].startswith("## AI Mentor\n\n")


def test_reset_and_append(spark):
    c = chat(spark)
    assert sorted(r["turn"] for r in L.since_reset(c).collect()) == [3, 4, 5, 6, 7]
    new = spark.createDataFrame([(1, "user", "hi", 0)], "conv_id long, role string, text string, pos int")
    assert L.append_turns(c, new).agg(F.max("turn")).first()[0] == 8


def test_streaming_recent_context_matches_batch(spark, tmpdir_path):
    c = chat(spark)
    src = os.path.join(tmpdir_path, "in")
    c.filter("turn < 4").write.parquet(src + "/b1")
    c.filter("turn >= 4").write.parquet(src + "/b2")
    stream = spark.readStream.schema(c.schema).option("recursiveFileLookup", True).parquet(src)
    q = (recent_context_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName("recent_ctx").option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select context from recent_ctx").collect()[-1]["context"]
    assert got == L.recent_context(c).collect()[0]["context"]
    q2 = (message_counts_stream(stream).writeStream.outputMode("complete").format("memory")
          .queryName("msg_counts").option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).start())
    q2.processAllAvailable()
    q2.stop()
    assert spark.sql("select messages from msg_counts").collect()[-1]["messages"] == 8


def test_features(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 0.0), ("b", 5.0, 1.0)], "g string, x double, y double")
    r = {row["x"]: row for row in X.group_relative(X.ratio(df, "x", "y"), "g", "x").collect()}
    assert r[1.0]["x_minus_g_mean"] == -1.0 and r[5.0]["x_minus_g_mean"] == 0.0
    assert r[3.0]["x_per_y"] is None and r[1.0]["x_per_y"] == 0.5
    f = {row["g"]: row["g_freq"] for row in X.frequency_encode(df, "g").collect()}
    assert f == {"a": 2, "b": 1}


def test_impute_and_split_deterministic(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 4.0, None), (3, 2.0, "a"), (4, float("nan"), "b")],
                               "k long, v double, s string")
    out = {r["k"]: r for r in M.impute(df, "mean").collect()}
    assert out[1]["v"] == 3.0 and out[4]["v"] == 3.0 and out[2]["s"] == "a"
    s1 = [r["split"] for r in M.split(df, "k").orderBy("k").collect()]
    s2 = [r["split"] for r in M.split(df.repartition(3), "k").orderBy("k").collect()]
    assert s1 == s2


def test_one_hot_frequency_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    rows = {r["s"]: r["s_onehot"] for r in M.one_hot(df, ["s"]).collect()}
    # labels b, a, then missing as its own label; Spark drops the encoder's extra invalid slot
    assert rows["b"] == [1.0, 0.0, 0.0] and rows["a"] == [0.0, 1.0, 0.0] and rows[None] == [0.0, 0.0, 1.0]


def test_join_back_broadcast_and_shuffled(spark):
    from tablesight.operators.common import join_back
    rows = [("hot", i) for i in range(300)] + [("cold", 1), (None, 2), (None, 3)]
    df = spark.createDataFrame(rows, "g string, v int")
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    expect = {("hot", 300), ("cold", 1), (None, 2)}
    got = {(r["g"], r["n"]) for r in join_back(df, stats, ["g"]).collect()}
    assert got == expect
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_back(df, stats, ["g"])
        assert out.columns == ["g", "v", "n"] and out.count() == len(rows)
        assert {(r["g"], r["n"]) for r in out.collect()} == expect
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_feature_candidates_rules(spark):
    import datetime as dt
    rows = [(float(i ** 3), float(i + 1), "g%d" % (i % 3), dt.datetime(2024, 1, 1 + i % 28),
             None if i % 5 == 0 else "v%d" % i) for i in range(80)]
    df = spark.createDataFrame(rows, "amount double, qty double, grp string, ts timestamp, tag string")
    got = {r["feature"]: r["expression"] for r in X.feature_candidates(df).collect()}
    assert got["log1p_amount"] == "log1p(`amount`)"
    assert "amount_per_qty" in got and "qty_per_amount" not in got
    assert {"ts_year", "ts_month", "ts_dow", "ts_hour"} <= set(got)
    assert "tag_missing" in got and "tag_freq" in got
    assert "amount_minus_grp_mean" in got and "amount_minus_tag_mean" not in got
    # every suggested expression runs on the frame
    df.selectExpr("*", *[f"{e} AS `{f}`" for f, e in got.items()]).count()


def test_model_messages_with_profile(spark):
    msgs = {r["seq"]: r for r in L.model_messages(chat(spark), system="S", profile="P").collect()}
    assert msgs[-1]["role"] == "system" and msgs[-1]["content"] == "S" + L.PROFILE_CONTEXT + "P"
    assert [msgs[t]["role"] for t in range(3)] == ["user", "assistant", "system"]


def test_scatter_sample_complete_rows(spark):
    from tablesight.operators import charts as G
    df = spark.createDataFrame([(float(i), None if i % 2 else 1.0) for i in range(200)], "a double, b double")
    s = G.scatter_sample(df, n=50, seed=1).collect()
    assert len(s) == 50 and all(r["b"] is not None for r in s)
    again = G.scatter_sample(df.repartition(13, "a"), n=50, seed=1).collect()
    assert sorted(s) == sorted(again) and sorted(s) != sorted(G.scatter_sample(df, n=50, seed=2).collect())
    assert len(G.scatter_sample(df, n=500).collect()) == 100 and G.scatter_sample(df.limit(0)).collect() == []


def test_correlation_ratio(spark):
    """A category that fixes a numeric target is found, one of a value per row isn't."""
    import math
    from tablesight.operators import health as H
    rows = [(1e9 + 10.0 * (i % 40), f"c{i % 40}", "ab"[i % 2], f"id{i}", None if i % 40 < 20 else "x") for i in range(400)]
    df = spark.createDataFrame(rows, "y double, code string, two string, id string, gap string")
    got = {r["column"]: r["value"] for r in H.correlation_ratios(df, "y", ["code", "two", "id", "gap"]).collect()}
    y = [r[0] for r in rows]
    mean, total = sum(y) / 400, sum((v - sum(y) / 400) ** 2 for v in y)
    def plain(i):
        groups = {}
        for r in rows:
            groups.setdefault(r[i], []).append(r[0])
        share = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values()) / total
        return math.sqrt(max(0, 1 - (1 - share) * 399 / (400 - len(groups))))
    assert abs(got["code"] - 1) < 1e-9 and abs(got["two"] - plain(2)) < 1e-6 and abs(got["gap"] - plain(4)) < 1e-6 and got["id"] is None
    assert [(r["column"], r["measure"]) for r in H.health_leakage(df, "y").collect()] == [("code", "correlation_ratio")]
    assert H.correlation_ratios(df, "y", []).collect() == []


def test_candidate_expressions_run(spark):
    """Names with back-ticks, NaN as missing, missing values in frequencies."""
    rows = [(float("nan") if i % 5 == 0 else float(i), i + 1, None if i % 4 == 0 else "v%d" % (i % 60)) for i in range(240)]
    df = spark.createDataFrame(rows, "`a``b` double, n long, tag string")
    for r in X.feature_candidates(df).collect():
        assert df.selectExpr(r["expression"] + " AS f").count() == 240
    by = {r["feature"]: r["expression"] for r in X.feature_candidates(df).collect()}
    assert df.selectExpr(by["a`b_missing"] + " AS f").agg(F.sum("f")).first()[0] == 48


def test_both_forms_on_empty_and_wide_tables(spark):
    from tablesight.operators import charts, profile
    for n in (3, 8, 12, 100):
        df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(n)))
        assert profile.describe_numeric(df).count() == n
        counts = profile.missing_counts(df).collect()
        assert len(counts) == n and all(r["missing"] == 0 for r in counts)
        if n <= 12:
            assert charts.correlation(df).count() == n * n


def test_one_row_repeated(spark):
    df = spark.range(100_000).selectExpr("'x' AS a", "cast(null as int) AS b").union(spark.createDataFrame([(None, 1), ("x", 1)], "a string, b int"))
    from tablesight.operators import profile
    assert profile.duplicate_count(df).first()[0] == 99_999
    assert [r["copies"] for r in profile.duplicate_groups(df).collect()] == [100_000]


def test_infinite_values_in_histograms(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    from tablesight.operators import charts
    got = charts.histogram(df, "v", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1, 1, 1] and got[0]["lower"] == 1 and got[2]["upper"] == 4


def test_information_of_any_form(spark):
    """A parabola, which no correlation sees, a text that tells the target's
    sign, missing values as a value, an identifier, plain entropies by hand."""
    import math
    from collections import Counter
    from tablesight.operators import health as H
    rows = [(float((x % 40 - 19.5) ** 2), float(x % 40), "low" if abs(x % 40 - 19.5) < 10 else "high", f"id{x}", None if x % 2 else "x") for x in range(800)]
    df = spark.createDataFrame(rows, "y double, x double, side string, id string, gap string")
    got = {r["column"]: r for r in H.health_information(df, "y", share=-1.0).collect()}
    assert set(got) == {"x", "side", "gap"} and abs(df.corr("x", "y")) < 0.01
    def binned(i):
        v = sorted(r[i] for r in rows)
        edges = [(lambda h: v[int(h)] + (v[min(int(h) + 1, 799)] - v[int(h)]) * (h % 1))(799 * k / 16) for k in range(1, 16)]
        return [sum(e < r[i] for e in edges) for r in rows]
    def entropy(values):
        return -sum(k / 800 * math.log(k / 800) for k in Counter(values).values())
    y = binned(0)
    for name, x in {"x": binned(1), "side": [r[2] for r in rows], "gap": [r[4] for r in rows]}.items():
        information = entropy(x) + entropy(y) - entropy(zip(x, y))
        chance = (len(set(zip(x, y))) - len(set(x)) - len(set(y)) + 1) / 1600
        assert abs(got[name]["mutual_information"] - max(information, 0)) < 1e-9
        assert abs(got[name]["share"] - max((information - chance) / entropy(y), 0)) < 1e-9
    assert got["x"]["share"] > 0.7 and got["gap"]["share"] < 0.05
    assert {r["column"] for r in H.health_information(df, "side").collect()} == {"x", "y"}
    assert H.health_information(df.selectExpr("x", "1.0 as k"), "k", share=-1.0).collect() == []
    assert H.health_information(df.limit(0), "y", share=-1.0).collect() == []
    assert H.health_information(df.select("y"), "y", share=-1.0).collect() == []


def test_models_by_row_count(spark):
    from tablesight.operators import health as H
    def models(n):
        return [r.model for r in H.recommend_models(spark.range(n).selectExpr("id", "id % 2 as k"), "k").orderBy("rank").collect()]
    assert models(40) == ["Logistic Regression"] and models(60) == ["Random Forest", "Logistic Regression"]
    assert models(300) == ["Random Forest", "Boosted Trees", "Logistic Regression"]
