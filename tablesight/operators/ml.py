"""Model training with Spark ML pipelines, evaluation metrics as plain
aggregates, one-feature linear regression in closed form, and model saving.

Pipelines: date parts -> impute numeric (mean) -> encode categories (one
position a value, or hashed words) -> assemble -> scale (for linear, SVM, MLP)
-> random Fourier features (SVM) -> estimator. Training runs on Spark executors; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    PCA, HashingTF, Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import categorical_columns, col, datetime_columns, numeric_columns
from ..session import materialize
from .common import lit, q
from .prep import split

# Model names accepted by ``train`` (the reference's list).
MODELS = ("Random Forest", "XGBoost", "Logistic Regression", "Linear Regression", "SVM",
          "Neural Network (MLP)", "K-Nearest Neighbors", "Decision Tree", "K-Means", "Gaussian Mixture")


# ---------------------------------------------------------------- metrics

def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, count)``."""
    return df.groupBy(col(label).cast("double").alias("label"),
                      col(prediction).cast("double").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(metric, value)``: accuracy, macro and weighted precision, recall
    and F1 (a class never predicted has precision 0)."""
    cm = confusion_matrix(df, label, prediction)
    actual = cm.groupBy(F.col("label").alias("c")).agg(F.sum("count").alias("actual"))
    pred = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("count").alias("predicted"))
    tp = cm.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"), F.col("count").alias("tp"))
    per = (actual.join(pred, "c", "full").join(tp, "c", "left")
                 .select("c", *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(x)
                                for x in ("actual", "predicted", "tp")]))
    per = (per.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)))
              .withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), F.lit(0.0)))
              .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                        F.col("precision") + F.col("recall")), F.lit(0.0))))
    cls = per.filter(F.col("actual") > 0)
    agg = per.agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
    ).crossJoin(cls.agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("actual")) / F.sum("actual")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("actual")) / F.sum("actual")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("f1_weighted")))
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted",
             "recall_weighted", "f1_weighted"]
    return agg.unpivot([], names, "metric", "value")


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", partitions: int | None = None) -> DataFrame:
    """``(metric, value)`` of a binary classifier's scores: roc_auc, pr_auc
    (average precision) and log_loss, over rows with label 0 or 1 and a score.

    Ties are exact: rows of equal score count half in roc_auc (Mann-Whitney)
    and enter pr_auc at once. Scores are counted, dealt to range partitions and
    written once; totals by partition (a row each) give every partition the
    counts before it, and running sums stay inside partitions, so no window
    holds all scores. Without one of the classes the areas are null. log_loss
    takes scores as probabilities, clipped to 1e-15 from 0 and 1; it is null if
    one is outside [0, 1].
    """
    y, x = col(label).cast("double"), col(score).cast("double")
    rows = df.select(y.alias("y"), F.nanvl(x, F.lit(None).cast("double")).alias("x")).filter("y IN (0, 1) AND x IS NOT NULL")
    counts = rows.groupBy("x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(n, F.desc("x")).withColumn("part", F.spark_partition_id()), "ranked-scores")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = dealt.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    before = totals.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(f"before_{c}") for c in "pq"])
    within = Window.partitionBy("part").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(before), "part").select(
        "x", "pos", "neg", (F.col("before_p") + F.sum("pos").over(within)).alias("tp"), (F.col("before_q") + F.sum("neg").over(within)).alias("fp"))
    clipped = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15)))
    loss = -(F.col("pos") * clipped(F.col("x")) + F.col("neg") * clipped(1 - F.col("x")))
    a = ranked.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("pairs"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
                   F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(loss).alias("loss"), F.count_if(F.expr("x < 0 OR x > 1")).alias("odd"))
    a = a.select(F.try_divide("pairs", F.col("P") * F.col("N")).alias("roc_auc"), F.when(F.col("N") > 0, F.try_divide("steps", "P")).alias("pr_auc"),
                 F.when(F.col("odd") == 0, F.try_divide("loss", F.col("P") + F.col("N"))).alias("log_loss"))
    return a.unpivot([], ["roc_auc", "pr_auc", "log_loss"], "metric", "value")


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(metric, value)``: mse, rmse, mae, r2 over rows with both present."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    d = df.select(y.alias("y"), p.alias("p")).na.drop()
    a = d.agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"),
              F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
              F.sum((F.col("y") - F.col("p")) ** 2).alias("_sse"),
              F.var_pop("y").alias("_vy"), F.count(F.lit(1)).alias("_n"))
    a = a.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                 (1 - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("_n"))).alias("r2"))
    return a.unpivot([], ["mse", "rmse", "mae", "r2"], "metric", "value")


def linreg_one(df: DataFrame, x: str, y: str) -> DataFrame:
    """Closed-form least squares of y on one feature: ``(slope, intercept,
    r2, n)``, one aggregate pass."""
    return df.agg(F.regr_slope(col(y), col(x)).alias("slope"),
                  F.regr_intercept(col(y), col(x)).alias("intercept"),
                  F.regr_r2(col(y), col(x)).alias("r2"), F.regr_count(col(y), col(x)).alias("n"))


# ---------------------------------------------------------------- pipelines (M1-M3 as stages, M5-M12, M15, M16)

#: Text columns of at most so many values are encoded one position a value.
ONE_HOT_MAX = 256
#: Positions that the values and words of all other text columns are hashed to,
#: for linear models. Others can't take so wide a vector and leave these out.
HASH_SLOTS = 1 << 16
#: L2 penalty of linear models of hashed words.
WIDE_PENALTY = 1e-3
#: Random Fourier features of the SVM.
FOURIER = 256
#: Dimensions that a Gaussian mixture works on.
MIXTURE_DIMENSIONS = 8
#: Numbers of clusters tried.
CLUSTERS = (2, 3, 4, 5, 6)
#: Names that mark the target when none is given, tried in this order.
TARGET_NAMES = ("target", "label", "class", "y")


def cardinalities(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """About how many different values each text column has, one scan."""
    if not cols:
        return {}
    found = df.agg(*[F.approx_count_distinct(col(c).cast("string"), 0.02).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return dict(zip(cols, found))


def _feature_stages(df: DataFrame, features: Sequence[str], scaled: bool, wide: bool):
    """Date parts -> impute numbers -> encode text columns -> assemble.

    Text columns of at most ONE_HOT_MAX values get a position for each value
    (so many labels at most reach the driver, and one for unseen ones; values
    begin with "=", as missing ones and empty texts need a name as well). Of the
    rest, whole values and their words are hashed to HASH_SLOTS positions if
    the model takes a ``wide`` sparse vector, else they are left out. Output:
    ``features``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    dates = [c for c in features if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    num = [c for c in features if c in numeric_columns(df)]
    cat = [c for c in features if c not in num and c not in dates]
    sizes = cardinalities(df, cat)
    few, many = [c for c in cat if sizes[c] <= ONE_HOT_MAX], [c for c in cat if sizes[c] > ONE_HOT_MAX]
    stages, inputs, numbers, made = [], [], list(num), {}
    if dates:
        made |= {f"_{part}_{i}": f"CAST({part}({q(c)}) AS DOUBLE)" for i, c in enumerate(dates) for part in ("year", "month", "weekday", "hour")}
        numbers += made
    made |= {f"_cat_{i}": f"coalesce(concat('=', CAST({q(c)} AS STRING)), 'missing')" for i, c in enumerate(few)}
    if wide and many:
        # The value itself and its words, each with the column's name.
        words = [f"concat(array({lit(c + '=')} || coalesce(CAST({q(c)} AS STRING), '')), "
                 f"transform(split(lower(coalesce(CAST({q(c)} AS STRING), '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> {lit(c + '~')} || w))" for c in many]
        made["_words"] = f"concat({', '.join(words)})"
    if made:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in made.items()) + " FROM __THIS__"))
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"_imp_{i}" for i in range(len(numbers))], strategy="mean"))
        inputs += [f"_imp_{i}" for i in range(len(numbers))]
    if few:
        n = range(len(few))
        stages.append(StringIndexer(inputCols=[f"_cat_{i}" for i in n], outputCols=[f"_idx_{i}" for i in n], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"_idx_{i}" for i in n], outputCols=[f"_hot_{i}" for i in n], handleInvalid="keep"))
        inputs += [f"_hot_{i}" for i in n]
    if not inputs:
        stages.append(SQLTransformer(statement="SELECT *, CAST(0 AS DOUBLE) AS _none FROM __THIS__"))
        inputs.append("_none")
    hashed = wide and bool(many)
    dense = "_dense" if scaled or hashed else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw" if scaled else dense, handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol=dense if hashed else "features", withMean=False, withStd=True))
    if hashed:
        stages.append(HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=HASH_SLOTS, binary=True))
        stages.append(VectorAssembler(inputCols=[dense, "_hashed"], outputCol="features", handleInvalid="keep"))
    return stages


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """cos(Wx + b) with seeded random W and b: inner products of the results
    approach the Gaussian kernel exp(-gamma |x - y|^2), so that a linear model
    of them separates what no plane can. Keeps the input's values in front."""

    n = Param(Params._dummy(), "n", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def set_all(self, source: str, to: str, n: int, width: int, seed: int) -> FourierFeatures:
        return self._set(inputCol=source, outputCol=to, n=n, width=width, gamma=1.0 / max(width, 1), seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        n, width, gamma, seed = (self.getOrDefault(p) for p in (self.n, self.width, self.gamma, self.seed))

        @F.pandas_udf("array<double>")
        def features(x: pd.Series) -> pd.Series:
            rng = np.random.default_rng(seed)
            w, b = rng.normal(0, np.sqrt(2 * gamma), (width, n)), rng.uniform(0, 2 * np.pi, n)
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy())
            return pd.Series(list(np.hstack([rows, np.sqrt(2 / n) * np.cos(rows @ w + b)])))

        return df.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(F.col(self.getInputCol())))))


def _prepare(df: DataFrame, features: Sequence[str] | None, target: str | None, key: str | None) -> list[str]:
    """All usable columns but the target and the split key (an identifier)."""
    usable = set(numeric_columns(df)) | set(categorical_columns(df)) | set(datetime_columns(df))
    simple = {f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    return list(features) if features else [c for c in df.columns if c not in (target, key) and c in usable and c in simple]


def infer_target(df: DataFrame, key: str | None = None) -> str:
    """The first column named like one of TARGET_NAMES, else the last one that
    is not the split key."""
    for name in TARGET_NAMES:
        for c in df.columns:
            if c.lower() == name and c != key:
                return c
    return [c for c in df.columns if c != key][-1]


def _estimator(model_type: str, kind: str, n_classes: int, n_features: int, seed: int):
    m = model_type.lower()
    if kind == "classification":
        if "forest" in m:
            return RandomForestClassifier(seed=seed, numTrees=50, featureSubsetStrategy="0.5"), False
        if "xgboost" in m or "boost" in m or "gbt" in m:
            gbt = GBTClassifier(seed=seed, maxIter=30)
            return (gbt if n_classes <= 2 else OneVsRest(classifier=gbt)), False
        if "logistic" in m:
            return LogisticRegression(maxIter=100), True
        if "svm" in m or "svc" in m:
            svc = LinearSVC(maxIter=100)
            return (svc if n_classes <= 2 else OneVsRest(classifier=svc)), True
        if "mlp" in m or "neural" in m:
            return MultilayerPerceptronClassifier(layers=[n_features, 16, max(2, n_classes)], seed=seed,
                                                  maxIter=200), True
        if "tree" in m:
            return DecisionTreeClassifier(seed=seed), False
    else:
        if "forest" in m:
            return RandomForestRegressor(seed=seed, numTrees=50, featureSubsetStrategy="0.5"), False
        if "xgboost" in m or "boost" in m or "gbt" in m:
            return GBTRegressor(seed=seed, maxIter=30), False
        if "linear" in m:
            return LinearRegression(maxIter=100), True
        if "tree" in m:
            return DecisionTreeRegressor(seed=seed), False
    raise ValueError(f"model {model_type!r} does not apply to {kind}")


def _takes_wide(model_type: str) -> bool:
    """Whether a model takes wide sparse vectors: the linear ones."""
    return any(x in model_type.lower() for x in ("logistic", "linear", "svm", "svc"))


def train(df: DataFrame, model_type: str, target: str | None = None, features: Sequence[str] | None = None,
          split_key: str | None = None, test_share: float = 0.2, kind: str | None = None, seed: int = 42, clusters: int | None = None):
    """Fit a pipeline; returns ``(model, predictions)`` where predictions are
    ``(split, label, prediction, score)`` for all rows; score is the chance of
    class 1 of a binary classifier that gives one, else null. Without a target
    the model is a clustering one (K-Means default; see ``train_clusters``).
    An empty target is inferred (``infer_target``). The split key is no feature.

    ``kind`` defaults to the problem type (classification for a non-numeric
    target or at most 20 values, else regression).
    """
    if target == "":
        target = infer_target(df, split_key)
    feats = _prepare(df, features, target, split_key)
    data = split(df, split_key or df.columns[0], test_share)
    if not target:
        return train_clusters(data, model_type, feats, seed, clusters)
    kind = kind or target_kind(df, target)
    rows = data.na.drop(subset=[target])
    first, label, n_classes = [], "label", 2
    if kind == "classification":
        first.append(StringIndexer(inputCol=target, outputCol=label, handleInvalid="skip",
                                   stringOrderType="alphabetAsc"))
        n_classes = rows.select(target).distinct().count()
    else:
        rows = rows.withColumn(label, col(target).cast("double"))
    if "nearest" in model_type.lower() or "knn" in model_type.lower():
        from .neighbors import train_knn
        prepared = Pipeline(stages=first + _feature_stages(df, feats, True, False)).fit(rows.filter("split = 'train'"))
        return train_knn(prepared, rows, kind)
    est, scaled = _estimator(model_type, kind, n_classes, 0, seed)
    stages = first + _feature_stages(df, feats, scaled, _takes_wide(model_type))
    fourier = isinstance(est, LinearSVC) or (isinstance(est, OneVsRest) and isinstance(est.getClassifier(), LinearSVC))
    if fourier or "mlp" in model_type.lower() or "neural" in model_type.lower():
        # The length of the vectors is known once the encoders are fitted.
        ready = Pipeline(stages=stages).fit(rows.filter("split = 'train'"))
        one = ready.transform(rows.limit(1))
        if fourier:
            narrow = "_dense" if "_dense" in one.columns else "features"
            width = len((one.select(narrow).first() or [()])[0])
            stages = [*ready.stages, FourierFeatures().set_all(narrow, "_fourier", FOURIER, width, seed)]
            inputs = "_fourier"
            if "_hashed" in one.columns:
                inputs = "_svm"
                stages.append(VectorSizeHint(inputCol="_fourier", size=width + FOURIER, handleInvalid="optimistic"))
                stages.append(VectorAssembler(inputCols=["_fourier", "_hashed"], outputCol=inputs, handleInvalid="keep"))
            for e in (est, est.getClassifier()) if isinstance(est, OneVsRest) else (est,):
                e.setFeaturesCol(inputs)
        else:
            stages = list(ready.stages)
            est, _ = _estimator(model_type, kind, n_classes, len((one.select("features").first() or [()])[0]), seed)
    if any(isinstance(x, HashingTF) for x in stages):
        # Words by the thousand fit any sample: weights are held down, and rare words not scaled up.
        (est.getClassifier() if isinstance(est, OneVsRest) else est).setRegParam(WIDE_PENALTY).setStandardization(False)
    model = Pipeline(stages=stages + [est]).fit(rows.filter("split = 'train'"))
    pred = model.transform(rows)
    score = vector_to_array(F.col("probability"))[1] if kind == "classification" and n_classes == 2 and "probability" in pred.columns else F.lit(None).cast("double")
    return model, pred.select("split", F.col(label).cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), score.alias("score"))


def train_clusters(data: DataFrame, model_type: str, feats: Sequence[str], seed: int = 42, clusters: int | None = None):
    """K-Means or a Gaussian mixture over the rows of split 'train'; predictions
    ``(split, label, prediction, score, features)``, label and score null.

    Without ``clusters`` the number of CLUSTERS with the best simplified
    silhouette is taken: 1 - (distance to the own centre) / (distance to the
    next), averaged in one pass for each number (ties: the smallest). The
    mixture works on MIXTURE_DIMENSIONS principal components, as covariances of
    encoded categories are singular.
    """
    stages = _feature_stages(data.drop("split"), feats, True, False)
    ready = Pipeline(stages=stages).fit(data.filter("split = 'train'"))
    rows = ready.transform(data)
    one = rows.select("features").first()
    width = len(one[0]) if one else 1
    final = list(ready.stages)
    if "gauss" in model_type.lower():
        final.append(PCA(k=min(MIXTURE_DIMENSIONS, width), inputCol="features", outputCol="_components").fit(rows.filter("split = 'train'")))
        rows = final[-1].transform(rows)
    column = "_components" if "gauss" in model_type.lower() else "features"
    rows = materialize(rows.select("split", F.col(column).alias("features")), "cluster-rows")
    known = rows.filter("split = 'train'")
    if clusters is None:
        scored = [(simplified_silhouette(known, KMeans(k=k, seed=seed).fit(known)), -k) for k in CLUSTERS]
        clusters = -max(scored)[1]
    est = (GaussianMixture if "gauss" in model_type.lower() else KMeans)(k=clusters, seed=seed).fit(known)
    pred = est.transform(rows).select("split", F.lit(None).cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"),
                                      F.lit(None).cast("double").alias("score"), "features")
    return PipelineModel(final + [est.copy({est.featuresCol: column})]), pred


def simplified_silhouette(rows: DataFrame, model) -> float:
    """Mean of 1 - a / b over rows, a and b the distances to the nearest and
    second nearest of the model's centres (0 where both are 0); -1 if the model
    has one centre. One pass."""
    centres = [c.tolist() for c in model.clusterCenters()]
    if len(centres) < 2:
        return -1.0
    x = vector_to_array(F.col("features"))
    away = F.array_sort(F.array(*[F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda s, v: s + v))
                                  for c in centres]))
    return rows.select(away.alias("d")).agg(F.avg(F.coalesce(1 - F.try_divide(F.col("d")[0], F.col("d")[1]), F.lit(0.0)))).first()[0] or 0.0


def target_kind(df: DataFrame, target: str) -> str:
    """classification or regression, by the problem type of the target."""
    from .health import problem_type
    return "classification" if problem_type(df, target).first()["problem_type"] == "classification" else "regression"


def evaluate(pred: DataFrame, kind: str, which: str = "test") -> DataFrame:
    """Metrics on the rows of one split of ``train``'s predictions."""
    part = pred.filter(F.col("split") == which)
    if kind == "classification":
        out = classification_metrics(part)
        if pred.filter("score IS NOT NULL").limit(1).count():
            out = out.unionByName(ranking_metrics(part))
        return out
    if kind == "clustering":
        if part.select("prediction").distinct().limit(2).count() < 2:
            # One cluster has no neighbour to be compared with.
            return pred.sparkSession.createDataFrame([("silhouette", None)], "metric string, value double")
        ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
        s = ev.evaluate(part.withColumn("prediction", F.col("prediction").cast("int")))
        return pred.sparkSession.createDataFrame([("silhouette", float(s))], "metric string, value double")
    return regression_metrics(part)


def save_model(model: PipelineModel, path: str) -> None:
    """Write the fitted pipeline (overwriting)."""
    model.write().overwrite().save(path)


def train_summary(df: DataFrame, model_type: str, target: str | None = None, **kw) -> DataFrame:
    """``(model, split, rows, metric, value)``: the summary printed at the end
    of training: row count and metrics of each split."""
    if target == "":
        target = infer_target(df, kw.get("split_key"))
    kind = kw.pop("kind", None) or (target_kind(df, target) if target else "clustering")
    _, pred = train(df, model_type, target, kind=kind, **kw)
    if kind != "clustering":
        # Every metric reads the predictions: each row is predicted once.
        pred = materialize(pred, "predictions")
    parts = [evaluate(pred, kind, which).withColumn("split", F.lit(which)) for which in ("train", "test")]
    counts = pred.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return (parts[0].unionByName(parts[1]).join(counts, "split")
            .select(F.lit(model_type).alias("model"), "split", "rows", "metric", "value"))
