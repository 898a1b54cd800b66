"""ML12-ML16: voting ensemble arithmetic over a long predictions table.

Input rows are (id, model, prediction[, probability]); weights are a small
(model, weight) table.  Everything is a grouped aggregation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.operators.kernels import KernelMap
from lucerna.session import checkpoint_dir

# Fixed default metric weights of the voting ensemble.
METRIC_WEIGHTS = {
    "Precision": 0.2,
    "F1": 0.2,
    "Recall": 0.1,
    "Specificity": 0.1,
    "MCC": 0.1,
    "Coefficient of Determination": 0.5,
    "Mean Absolute Error": -0.1,
    "Mean Squared Error": -0.1,
    "Root Mean Squared Error": -0.1,
}


def model_weights(metrics: DataFrame, models: DataFrame | None = None,
                  metric_weights: dict[str, float] | None = None) -> DataFrame:
    """ML12: score = sum(metric weight x value); rank desc (ties by model name);
    weight = (1 / rank) / sum(1 / rank).  Models without metrics score 0.

    ``metrics`` is the long (model, metric, value) table; ``models`` the list
    of ensemble members (default: the models present in ``metrics``).
    """
    mw = metric_weights or METRIC_WEIGHTS
    spark = metrics.sparkSession
    wdf = spark.createDataFrame(list(mw.items()), "metric string, metric_weight double")
    scores = (metrics.join(F.broadcast(wdf), "metric")  # fixed small table
              .groupBy("model").agg(F.sum(F.col("metric_weight") * F.col("value")).alias("score")))
    members = models if models is not None else metrics.select("model").distinct()
    scored = members.join(scores, "model", "left").select(
        "model", F.coalesce("score", F.lit(0.0)).alias("score"))
    # one row per ensemble member: a tiny table, global window is fine
    w = Window.orderBy(F.col("score").desc(), F.col("model"))
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    inv = ranked.withColumn("_inv", 1.0 / F.col("rank"))
    return inv.select("model", "score", "rank",
                      (F.col("_inv") / F.sum("_inv").over(Window.partitionBy())).alias("weight"))


def weighted_class_vote(preds: DataFrame, weights: DataFrame, id_col: str = "id") -> DataFrame:
    """ML13: the class with the largest weight sum per row; ties -> lowest class."""
    per = (preds.join(F.broadcast(weights.select("model", "weight")), "model")  # one row per model
           .groupBy(id_col, "prediction").agg(F.sum("weight").alias("_w")))
    w = Window.partitionBy(id_col).orderBy(F.col("_w").desc(), F.col("prediction"))
    return (per.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(id_col, "prediction", F.col("_w").alias("vote_weight")))


def weighted_regression(preds: DataFrame, weights: DataFrame, id_col: str = "id") -> DataFrame:
    """ML14: weighted mean of the models' predictions."""
    j = preds.join(F.broadcast(weights.select("model", "weight")), "model")
    return j.groupBy(id_col).agg(
        (F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("prediction"))


def mean_probability(preds: DataFrame, id_col: str = "id", prob_col: str = "probability") -> DataFrame:
    """ML15: unweighted mean of the base models' class probabilities.

    ``prob_col`` holds the class-1 probability (binary) or an array of class
    probabilities; the output has ``class`` and ``probability`` per row.
    """
    dt = preds.schema[prob_col].dataType.typeName()
    if dt == "array":
        long = preds.select(id_col, F.posexplode(prob_col).alias("class", "_p"))
    else:
        p = F.col(prob_col).cast("double")
        long = preds.select(id_col, F.explode(F.array(
            F.struct(F.lit(0).alias("class"), (1.0 - p).alias("_p")),
            F.struct(F.lit(1).alias("class"), p.alias("_p")))).alias("s")).select(id_col, "s.*")
    return long.groupBy(id_col, "class").agg(F.avg("_p").alias("probability"))


def fit_voting(train: DataFrame, test: DataFrame, base_models, feature_cols, task: str = "classification",
               id_col: str = "id", label: str = "label", n_classes: int = 2,
               metric_weights: dict[str, float] | None = None) -> dict:
    """ML11: fit the base models, score the test rows once each into one long
    predictions table, weight the models by their test metrics (ML12) and
    combine: weighted class vote (ML13) or weighted mean (ML14), plus the mean
    class probability (ML15).  An empty model list is an error.
    """
    from lucerna.operators.models import fit_model
    if not base_models:
        raise ValueError("the voting ensemble needs at least one base model")
    models = {name: fit_model(train, name, task, feature_cols, n_classes=n_classes, label=label) for name in base_models}
    return vote(models, test, task, id_col, label, n_classes, metric_weights)


def vote(models: dict[str, PipelineModel], test: DataFrame, task: str = "classification", id_col: str = "id",
         label: str = "label", n_classes: int = 2, metric_weights: dict[str, float] | None = None) -> dict:
    """ML11 with fitted models: every one scores the test rows once, then ML12-ML15 as in :func:`fit_voting`.

    A model whose features the test table does not have is an error.
    """
    from lucerna.operators.metrics import classification_metrics, regression_metrics
    from lucerna.operators.models import predict
    if not models:
        raise ValueError("the voting ensemble needs at least one base model")
    for name, m in models.items():
        if missing := sorted(set(input_features(m)) - set(test.columns)):
            raise ValueError(f"model {name} needs features that the table does not have: {', '.join(missing)}")
    checkpoint_dir(test.sparkSession)
    preds = reduce(DataFrame.unionByName, [predict(m, test, keep=[id_col, label]).withColumn("model", F.lit(name))
                                           for name, m in sorted(models.items())])
    preds = preds.checkpoint()   # scored once, read by the metrics and the vote
    if task == "classification":
        hard = preds.withColumn("prediction", F.col("prediction").cast("int")).withColumn(
            label, F.col(label).cast("int"))
        metrics = classification_metrics(hard, label, group_cols=["model"], multiclass=n_classes > 2)
        weights = model_weights(metrics, metric_weights=metric_weights)
        voted = weighted_class_vote(hard.select(id_col, "model", "prediction"), weights, id_col)
        prob = mean_probability(preds.select(id_col, "model", "probability"), id_col)
        return {"predictions": preds, "metrics": metrics, "weights": weights, "vote": voted, "probability": prob}
    metrics = regression_metrics(preds, label, group_cols=["model"])
    weights = model_weights(metrics, metric_weights=metric_weights)
    voted = weighted_regression(preds.select(id_col, "model", "prediction"), weights, id_col)
    return {"predictions": preds, "metrics": metrics, "weights": weights, "vote": voted}


def input_features(model: PipelineModel) -> list[str]:
    """Columns that a pipeline's assemblers and kernel maps read and none of its earlier stages makes."""
    made: set[str] = set()
    out: list[str] = []
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            out += [c for c in stage.getInputCols() if c not in made]
            made.add(stage.getOutputCol())
        elif isinstance(stage, SQLTransformer):
            made.update(re.findall(r"\bAS `?(\w+)`?", stage.getStatement()))
            out += [c for c in re.findall(r"CAST\(`(\w+)` AS DOUBLE\)", stage.getStatement()) if c not in out]
        elif isinstance(stage, KernelMap):
            out += [c for c in json.loads(stage.getOrDefault(stage.state))["cols"] if c not in made]
            made.add(stage.getOrDefault(stage.outputCol))
    return out


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    """One saved pipeline per model, in a sub-folder of its name."""
    from lucerna.operators.models import save_model
    for name, m in models.items():
        save_model(m, f"{folder.rstrip('/')}/{name}")


def load_models(spark: SparkSession, folder: str, base_models: Sequence[str] | None = None) -> dict[str, PipelineModel]:
    """ML11: the saved pipelines in the sub-folders of ``folder``, by name.

    Sub-folders are found through Spark's file reader, on any file system it
    reads.  The name ends at the first underscore; other names than ``base_models``
    (all if None) and what is no saved pipeline are passed over.  Two sub-folders
    with one name, or no model at all, are errors.
    """
    from lucerna.operators.models import load_model
    try:
        found = (spark.read.text(f"{folder.rstrip('/')}/*/metadata").select(F.col("_metadata.file_path").alias("path"), "value")
                 .where(F.get_json_object("value", "$.class").endswith("PipelineModel")).select("path").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    out: dict[str, PipelineModel] = {}
    for path in sorted({r["path"].rsplit("/metadata/", 1)[0] for r in found}):
        name = path.rsplit("/", 1)[1].split("_")[0]
        if base_models is not None and name not in base_models:
            continue
        if name in out:
            raise ValueError(f"two saved models are called {name}")
        out[name] = load_model(path)
    if not out:
        raise ValueError(f"no saved models in {folder}")
    return out
