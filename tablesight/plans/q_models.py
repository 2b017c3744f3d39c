"""Registered model queries: exact metrics and closed-form regression
(oracle-checked), and training summaries per algorithm (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as ML
from .inputs import oracle_from
from .registry import T, register


@register("linreg_one", """
select regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept,
       regr_r2(l_extendedprice, l_quantity) as r2, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem""", digits=None)
def linreg_one(spark, sf):
    return ML.linreg_one(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("metrics_regression", """
with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem),
p as (select l_extendedprice as y, a + b * l_quantity as p from lineitem, f),
m as (select avg((y - p) * (y - p)) as mse, avg(abs(y - p)) as mae, sum((y - p) * (y - p)) as sse,
             var_pop(y) * count(*) as sst from p)
select 'mse' as metric, round(mse, 4) as value from m union all select 'rmse', round(sqrt(mse), 4) from m
union all select 'mae', round(mae, 4) from m union all select 'r2', round(1 - sse / sst, 4) from m""")
def metrics_regression(spark, sf):
    li = T(spark, sf, "lineitem")
    fit = ML.linreg_one(li, "l_quantity", "l_extendedprice")
    pred = li.crossJoin(F.broadcast(fit)).select(
        F.col("l_extendedprice").alias("label"),
        (F.col("intercept") + F.col("slope") * F.col("l_quantity")).alias("prediction"))
    return ML.regression_metrics(pred)


_CLS_PRED = "select cast(quality as double) as label, case when lang = 'en' then 1.0::double else 0.0::double end as prediction from classification"


@register("confusion_matrix", oracle_from("classification") + f"select label, prediction, count(*) as count from ({_CLS_PRED}) group by all")
def confusion_matrix(spark, sf):
    return ML.confusion_matrix(_cls_pred(spark, sf))


def _cls_pred(spark, sf):
    c = T(spark, sf, "classification")
    return c.select(F.col("quality").cast("double").alias("label"),
                    F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("prediction"))


@register("metrics_classification", oracle_from("classification") + f""", p as ({_CLS_PRED}),
cls as (select label as c from p union select prediction from p),
per as (select c, cast((select count(*) from p where label = c) as double) as actual,
               cast((select count(*) from p where prediction = c) as double) as predicted,
               cast((select count(*) from p where label = c and prediction = c) as double) as tp from cls),
m as (select c, actual, tp, coalesce(tp / nullif(predicted, 0), 0) as pr, coalesce(tp / nullif(actual, 0), 0) as rc from per),
f as (select *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) as f1 from m)
select 'accuracy' as metric, round(sum(tp) / sum(actual), 4) as value from f
union all select 'precision_macro', round(avg(pr), 4) from f where actual > 0
union all select 'recall_macro', round(avg(rc), 4) from f where actual > 0
union all select 'f1_macro', round(avg(f1), 4) from f where actual > 0
union all select 'precision_weighted', round(sum(pr * actual) / sum(actual), 4) from f where actual > 0
union all select 'recall_weighted', round(sum(rc * actual) / sum(actual), 4) from f where actual > 0
union all select 'f1_weighted', round(sum(f1 * actual) / sum(actual), 4) from f where actual > 0""")
def metrics_classification(spark, sf):
    return ML.classification_metrics(_cls_pred(spark, sf))


_RANKED = "select cast(quality as double) as label, (1 + least(n_chars // 50, 97)) / 100.0::double as score from classification"


@register("metrics_ranking", oracle_from("classification") + f""", s as ({_RANKED}),
g as (select score, sum(label) as pos, sum(1 - label) as neg from s group by score),
r as (select *, sum(pos) over w as tp, sum(neg) over w as fp from g window w as (order by score desc rows unbounded preceding)),
t as (select sum(label) as p, sum(1 - label) as n, -avg(label * ln(score) + (1 - label) * ln(1 - score)) as loss from s)
select 'roc_auc' as metric, round((select sum(neg * (tp - pos / 2)) from r) / (p * n), 4) as value from t
union all select 'pr_auc', round((select sum(pos * tp / (tp + fp)) from r) / p, 4) from t
union all select 'log_loss', round(loss, 4) from t""")
def metrics_ranking(spark, sf):
    """Areas under ROC and precision-recall and log loss of a score with many
    ties: the length of a document in steps of 50 characters, for its quality."""
    c = T(spark, sf, "classification")
    score = (1 + F.least(F.expr("n_chars div 50"), F.lit(97))) / 100.0
    return ML.ranking_metrics(c.select(F.col("quality").alias("label"), score.alias("score")))


def _trainer(model: str, table: str, target: str | None, key: str):
    def run(spark, sf):
        df = T(spark, sf, table)
        if table == "classification":
            df = df.drop("toxic")
        return ML.train_summary(df, model, target, split_key=key)
    return run


for _name, _model, _table, _target, _key in [
    ("train_random_forest", "Random Forest", "classification", "quality", "doc_id"),
    ("train_xgboost", "XGBoost", "classification", "quality", "doc_id"),
    ("train_logistic_regression", "Logistic Regression", "classification", "quality", "doc_id"),
    ("train_svm", "SVM", "classification", "quality", "doc_id"),
    ("train_mlp", "Neural Network (MLP)", "classification", "quality", "doc_id"),
    ("train_decision_tree", "Decision Tree", "classification", "quality", "doc_id"),
    ("train_linear_regression", "Linear Regression", "regression", "l_extendedprice", "l_orderkey"),
    ("train_random_forest_regression", "Random Forest", "regression", "l_extendedprice", "l_orderkey"),
    ("train_kmeans", "K-Means", "classification", None, "doc_id"),
    ("train_knn", "K-Nearest Neighbors", "classification", "quality", "doc_id"),
    ("train_gaussian_mixture", "Gaussian Mixture", "classification", None, "doc_id"),
]:
    register(_name)(_trainer(_model, _table, _target, _key))


@register("knn_embeddings")
def knn_embeddings(spark, sf):
    """Every embedding's 5 nearest others, by hashing fitted to the table."""
    from ..operators.neighbors import knn_approx
    return knn_approx(T(spark, sf, "embeddings"), 5, "vec_id")


@register("knn_centroids", """
with cells as (select label, i, avg(x) as x from
                 (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings)
               group by label, i),
c as (select label, list(x order by i) as v from cells group by label),
d as (select c.label, e.vec_id as id,
             sqrt(list_sum(list_transform(list_zip(c.v, e.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as distance
      from c, embeddings e)
select * from (select label, cast(row_number() over (partition by label order by distance, id) as integer) as rank, id,
                      round(distance, 4) as distance from d) where rank <= 5""")
def knn_centroids(spark, sf):
    """The 5 embeddings nearest to each label's centroid (exact)."""
    from ..operators.neighbors import nearest_to_centroids
    e = T(spark, sf, "embeddings")
    return nearest_to_centroids(e, "label", 5, base_id="vec_id")
