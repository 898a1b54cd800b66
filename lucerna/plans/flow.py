"""End-to-end flow: prepare -> split -> fit -> evaluate -> explain.

``train_evaluate_explain`` is the library's main path (the reference's
train + analysis + interpretability run) for one model: everything is a lazy
DataFrame plan except the model fit and the few scalars it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import explain as EX
from lucerna.operators import metrics as M
from lucerna.operators import models as ML
from lucerna.operators import sample as SA
from lucerna.operators import scale as S
from lucerna.session import checkpoint_dir


def train_evaluate_explain(df: DataFrame, feature_cols: Sequence[str], id_col: str = "id",
                           label: str = "label", task: str = "classification",
                           model_name: str = "LR", normalisation: str | None = "SMM",
                           train_size: float = 0.8) -> dict[str, DataFrame]:
    """Returns the split table, test predictions, metric bundle and attributions."""
    cols = list(feature_cols)
    # The modelling table feeds several passes (scaler statistics, split count,
    # ranks): cut its lineage once, in the shared folder of spark.checkpoint.dir.
    checkpoint_dir(df.sparkSession)
    data = df.select(id_col, *cols, label).checkpoint(eager=True)
    if normalisation:
        data = S.normalise(data, cols, normalisation, id_col)      # fitted on the whole table
        cols = S.feature_names_after(cols, normalisation)
    split = SA.train_test_split(data, id_col, train_size)
    # the split feeds a fit, a scoring pass and the explanation background
    split = split.persist()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    # one row per class: the count decides between the binary and the multiclass formulas
    n_classes = split.select(label).distinct().count() if task == "classification" else 2
    model = ML.fit_model(train, model_name, task, cols, n_classes=max(2, n_classes), label=label)
    scored = ML.predict(model, test, keep=[id_col, label])
    if task == "classification":
        scored = scored.withColumn("prediction", F.col("prediction").cast("int"))
        metrics = M.classification_metrics(scored.withColumn(label, F.col(label).cast("int")), label,
                                           multiclass=n_classes > 2)
    else:
        metrics = M.regression_metrics(scored, label)
    out = {"split": split, "predictions": scored, "metrics": metrics, "model": model}
    if model_name == "LR" and n_classes <= 2:
        coefs = ML.linear_coefficients(model, cols)
        local = EX.linear_shapley(test, {c: coefs[c] for c in cols}, train, id_col)
        out["shapley_local"] = local
        out["shapley_global"] = EX.shapley_global(local)
    return out


def flagship(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Metric bundle and global Shapley attributions of the LR run as one table."""
    res = train_evaluate_explain(df, feature_cols)
    m = res["metrics"].select(F.lit("metric").alias("section"), F.col("metric").alias("name"),
                              F.col("value").cast("double").alias("value"))
    a = res["shapley_global"].select(F.lit("shapley").alias("section"), F.col("feature").alias("name"),
                                     rnd("attribution").alias("value"))
    return m.unionByName(a)
