"""ML1-ML22: model families as Spark ML pipelines, scoring and model tables.

Every model is a ``PipelineModel``: VectorAssembler -> (feature map) ->
estimator, so saving / loading (IO9) and batch or streaming scoring use the
standard Spark ML machinery.  Fitting is distributed by MLlib; only fitted
parameters live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.operators.boosting import fit_boosted
from lucerna.operators.kernels import KERNELS, KernelMap, fit_svr
from lucerna.operators.network import fit_network

MODEL_SEED = 2020
MODELS = ["DT", "RF", "SVM", "XGBOOST", "HGB", "ANN", "DNN", "LR", "BAG", "KNN", "RLF", "RP", "VOT"]


def build_pipeline(name: str, task: str, feature_cols: Sequence[str], n_classes: int = 2,
                   params: dict | None = None, label: str = "label",
                   weight_col: str | None = None, seed: int = MODEL_SEED) -> Pipeline:
    """Pipeline for a model family.  ``task`` is 'classification' or 'regression'."""
    params = dict(params or {})
    cls = task == "classification"
    stages = []
    cols = list(feature_cols)
    feats = "features"
    if name == "SVM":
        kernel_map, params = _kernel_map(None, cols, params, seed)
        if kernel_map:
            stages.append(kernel_map)
    if not stages:
        stages.append(VectorAssembler(inputCols=cols, outputCol=feats, handleInvalid="keep"))
    common = dict(featuresCol=feats, labelCol=label)
    wc = dict(weightCol=weight_col) if weight_col else {}
    if name == "DT":
        est = (DecisionTreeClassifier(seed=seed, **common, **wc, **params) if cls else
               DecisionTreeRegressor(**{"maxDepth": 4, "minInstancesPerNode": 2, "seed": seed,
                                        **common, **params}))
    elif name == "RF":
        p = {"numTrees": 100, "seed": seed, **params}
        est = RandomForestClassifier(**common, **wc, **p) if cls else RandomForestRegressor(**common, **p)
    elif name == "BAG":
        p = {"numTrees": 10, "featureSubsetStrategy": "all", "subsamplingRate": 1.0,
             "bootstrap": True, "seed": seed, **params}
        est = RandomForestClassifier(**common, **wc, **p) if cls else RandomForestRegressor(**common, **p)
    elif name == "XGBOOST":
        p = {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "seed": seed, **params}
        if cls:
            est = GBTClassifier(**common, **p)
            if n_classes > 2:
                est = OneVsRest(classifier=GBTClassifier(**p), **common)
        else:
            est = GBTRegressor(**common, **p)
    elif name == "LR":
        if cls:
            est = LogisticRegression(**common, **wc, **{"maxIter": 100, **params})
        else:
            est = LinearRegression(**common, **wc, **params)
    elif name == "SVM":
        if cls:
            base = LinearSVC(**{"maxIter": 100, "regParam": 0.0, **params})
            est = (LinearSVC(**common, **wc, **{"maxIter": 100, **params}) if n_classes <= 2
                   else OneVsRest(classifier=base, **common))
        else:
            raise ValueError("support-vector regression is fitted by fit_model, not as an estimator")
    elif name == "ANN":
        if not cls:
            raise ValueError("a network for numbers is fitted by fit_model, not as an estimator")
        hidden = params.pop("hidden", [16, 8])
        est = MultilayerPerceptronClassifier(layers=[len(cols), *hidden, max(n_classes, 2)],
                                             seed=seed, **common, **{"maxIter": 80, **params})
    else:
        raise ValueError(f"{name} is not a Spark ML pipeline model (see neighbours / rules)")
    stages.append(est)
    return Pipeline(stages=stages)


def _kernel_map(df: DataFrame | None, cols: list[str], params: dict, seed: int) -> tuple[KernelMap | None, dict]:
    """The stage of an SVM's kernel map (linear: none), and the parameters left; poly and sigmoid take landmarks from ``df``."""
    params = dict(params)
    kernel = params.pop("kernel", "rbf")
    if kernel not in KERNELS:
        raise ValueError(f"SVM kernel {kernel!r} is not offered; use one of {', '.join(KERNELS)}")
    own = {k: params.pop(k) for k in ("n_components", "gamma", "coef0", "degree") if k in params}
    if kernel == "linear":
        return None, params
    if kernel == "rbf":
        return KernelMap.fourier(cols, own.get("gamma"), own.get("n_components", 100), seed), params
    if df is None:
        raise ValueError(f"the {kernel} kernel takes landmarks from the rows: use fit_model")
    return KernelMap.nystroem(df, cols, kernel, **own), params


def _fit_svm(data: DataFrame, task: str, cols: list[str], n_classes: int, params: dict, label: str, weight_col: str | None,
             seed: int) -> PipelineModel:
    """SVM with a kernel map: hinge loss for classes, the epsilon-insensitive one for numbers."""
    kernel_map, params = _kernel_map(data, cols, params, seed)
    if task == "regression":
        return fit_svr(data, kernel_map, cols, label, **params)
    linear = build_pipeline("SVM", task, cols, n_classes, {**params, "kernel": "linear"}, label, weight_col, seed).getStages()
    return Pipeline(stages=[kernel_map, linear[-1]] if kernel_map else linear).fit(data)


def fit_model(df: DataFrame, name: str, task: str, feature_cols: Sequence[str],
              n_classes: int = 2, params: dict | None = None, label: str = "label",
              weight_col: str | None = None, seed: int = MODEL_SEED) -> PipelineModel:
    """Fit a model family on a DataFrame (the label cast to double).

    SVM takes ``kernel`` (rbf, linear, poly, sigmoid) with ``gamma``, ``coef0``, ``degree`` and
    ``n_components``; for regression also ``c`` and ``epsilon``.  XGBOOST is Spark's first-order
    boosting, HGB the second-order one with the settings of :class:`~lucerna.operators.boosting.Boosting`.
    ANN is Spark's perceptron for classes, DNN (and ANN for numbers) the dense network of
    :func:`~lucerna.operators.network.fit_network`.
    """
    data = df.withColumn(label, F.col(label).cast("double"))
    if name == "SVM":
        return _fit_svm(data, task, list(feature_cols), n_classes, params or {}, label, weight_col, seed)
    if name == "HGB":
        return fit_boosted(data, feature_cols, task, n_classes, label, weight_col, **{"seed": seed, **(params or {})}).pipeline()
    if name == "DNN" or (name == "ANN" and task == "regression"):
        return fit_network(data, feature_cols, task, n_classes, label, weight_col, **{"seed": seed, **(params or {})}).pipeline()
    return build_pipeline(name, task, feature_cols, n_classes, params, label, weight_col, seed).fit(data)


def few_partitions(data: DataFrame, rows: int = 500_000, many: int = 4) -> DataFrame:
    """Rows for a fit of hundreds of short passes: a partition a core, more where one would hold over ``rows`` rows.

    Only where there are more than ``many`` partitions a core.  Spark's trees place their split
    candidates by a sample drawn partition by partition (above 10,000 rows), so other partitions mean other candidates.
    """
    cores = data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() <= many * cores:
        return data
    return data.coalesce(max(cores, -(-data.count() // rows)))


def probability_array(scored: DataFrame) -> Column:
    """The class probabilities of a scored table as an array, whether its model gives a vector or an array."""
    p = F.col("probability")
    return p if scored.schema["probability"].dataType.typeName() == "array" else vector_to_array(p)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """Score: ``keep`` columns, ``prediction`` and, for classifiers with one,
    ``probability`` as an array of class probabilities (ML16 fallback
    ``[1 - p, p]`` when the model has only a hard label)."""
    out = model.transform(df)
    cols = [F.col(c) for c in keep if c in out.columns]
    pred = F.col("prediction")
    if "probability" in out.columns:
        prob = probability_array(out)
    else:
        prob = F.array(1.0 - pred, pred)
    return out.select(*cols, pred.alias("prediction"), prob.alias("probability"))


def batch_scores(scored: DataFrame, task: str, id_col: str = "id") -> DataFrame:
    """ML17: ``Sample ID, Predicted class, Probability`` per row.

    Classification: class = argmax, probability = max; regression: class -1
    and probability = the prediction.
    """
    if task == "classification":
        pmax = F.array_max("probability")
        cls = (F.array_position("probability", pmax) - 1).cast("int")
        return scored.select(F.col(id_col).alias("Sample ID"), cls.alias("Predicted class"),
                             pmax.alias("Probability"))
    return scored.select(F.col(id_col).alias("Sample ID"), F.lit(-1).alias("Predicted class"),
                         F.col("prediction").cast("double").alias("Probability"))


def rulefit_hard_label(scored: DataFrame, col: str = "prediction") -> DataFrame:
    """ML20: the reference's RuleFit label: round to 2 decimals, then truncate."""
    x = F.col(col).cast("double")
    r2 = F.floor(F.abs(x) * 100.0 + 0.5) / 100.0 * F.signum(x)
    return scored.withColumn("hard_label", r2.cast("int"))


def leaf_statistics(model: PipelineModel, df: DataFrame, label: str = "label") -> DataFrame:
    """ML21: rows, mean label and the model's prediction per leaf of a fitted tree."""
    tree = model.stages[-1]
    tree.setLeafCol("leaf")
    out = model.transform(df)
    leaf = F.col("leaf")
    if out.schema["leaf"].dataType.typeName() != "double":  # ensembles: one leaf per tree
        out = out.select("*", F.posexplode(vector_to_array(leaf)).alias("tree", "_leaf"))
        out = out.withColumn("leaf", F.col("_leaf"))
        keys = ["tree", "leaf"]
    else:
        keys = ["leaf"]
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                  F.avg(F.col(label).cast("double")).alias("mean_label"),
                                  F.avg("prediction").alias("prediction"))


def learning_history(model: PipelineModel) -> list[tuple[int, float]]:
    """ML22: (iteration, objective) of iterative models (LR, MLP)."""
    est = model.stages[-1]
    summ = est.summary() if callable(getattr(est, "summary", None)) else getattr(est, "summary", None)
    hist = list(summ.objectiveHistory) if summ is not None else []
    return [(i, float(v)) for i, v in enumerate(hist)]


def learning_history_df(spark, model: PipelineModel) -> DataFrame:
    return spark.createDataFrame(learning_history(model) or [(0, float("nan"))],
                                 "iteration int, objective double")


def linear_coefficients(model: PipelineModel, feature_cols: Sequence[str]) -> dict[str, float]:
    """Fitted coefficients of a binary LR / linear model by feature name (+ intercept)."""
    est = model.stages[-1]
    coef = est.coefficients.toArray().tolist()
    out = dict(zip(feature_cols, coef))
    out["__intercept__"] = float(est.intercept)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    """IO9: Spark ML writer (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """IO9: Spark ML reader."""
    return PipelineModel.load(path)
