"""ML7 RuleFit (Friedman & Popescu 2008) and its rule table (ML18).

1. A boosted tree ensemble is fitted on the response (distributed, MLlib).
2. Its node table is read back from the Spark ML writer's parquet (bounded:
   trees x nodes) and every non-root node becomes a rule: the conjunction of
   the split conditions on its path (conditions on one feature merged).
3. Rules (0/1) and winsorised linear terms are one ``SQLTransformer``
   statement, followed by an L1-penalised logistic regression -- so the
   fitted RuleFit model is an ordinary PipelineModel (save / load / stream).
4. The rule table reports coef, support (share of rows a rule covers, one
   aggregate pass) and importance |coef| sqrt(s (1 - s)).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.ranking import exact_quantiles
from lucerna.session import checkpoint_dir


def _path_rules(nodes: list[dict], max_rules: int) -> list[list[tuple[int, str, float]]]:
    """Rules of one tree: for every non-root node, the merged conditions of its path."""
    by_id = {n["id"]: n for n in nodes}
    rules = []

    def walk(nid, conds):
        n = by_id[nid]
        if conds:
            rules.append(conds)
        left, right = n["leftChild"], n["rightChild"]
        if left is None or left < 0 or n["featureIndex"] is None or n["featureIndex"] < 0:
            return
        f, thr = n["featureIndex"], n["threshold"]
        walk(left, conds + [(f, "<=", thr)])
        walk(right, conds + [(f, ">", thr)])
    walk(0, [])
    out = []
    for conds in rules:
        merged: dict[tuple[int, str], float] = {}
        for f, op, t in conds:
            k = (f, op)
            merged[k] = min(merged.get(k, t), t) if op == "<=" else max(merged.get(k, t), t)
        out.append(sorted((f, op, t) for (f, op), t in merged.items()))
    return out[:max_rules]


def _rule_text(conds, names=None) -> str:
    fmt = (lambda f: names[f]) if names else (lambda f: f"feature_{f}")
    return " and ".join(f"{fmt(f)} {op} {t!r}" for f, op, t in conds)


def _rule_sql(conds, cols) -> str:
    return " AND ".join(f"CAST(`{cols[f]}` AS DOUBLE) {op} {t!r}" for f, op, t in conds)


def fit_rulefit(df: DataFrame, feature_cols: Sequence[str], label: str = "label",
                n_trees: int = 20, max_depth: int = 3, reg_param: float = 0.005,
                max_rules: int = 2000, winsor: float = 0.025, seed: int = 2020):
    """Fit RuleFit; returns (PipelineModel, raw rules DataFrame).

    The raw rule table has ``rule`` (with feature_<i> names), ``type``
    ('rule' / 'linear'), ``coef``, ``support`` and ``importance``.
    """
    spark = df.sparkSession
    cols = list(feature_cols)
    data = df.withColumn(label, F.col(label).cast("double"))
    va = VectorAssembler(inputCols=cols, outputCol="_rf_features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="_rf_features", labelCol=label, maxIter=n_trees,
                       maxDepth=max_depth, seed=seed).fit(va.transform(data))
    path = os.path.join(checkpoint_dir(spark), f"rulefit-trees-{uuid.uuid4().hex}")
    gbt.write().overwrite().save(path)
    node_rows = (spark.read.parquet(os.path.join(path, "data"))
                 .select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild",
                         F.col("nodeData.split.featureIndex").alias("featureIndex"),
                         F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
                 .collect())
    trees: dict[int, list[dict]] = {}
    for r in node_rows:
        trees.setdefault(r["treeID"], []).append(r.asDict())
    seen, rules = set(), []
    for t in sorted(trees):
        for conds in _path_rules(trees[t], max_rules):
            key = tuple(conds)
            if key not in seen and len(rules) < max_rules:
                seen.add(key)
                rules.append(conds)
    # winsorised linear terms
    long = data.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                            for c in cols])).alias("s")).select("s.*")
    qs = {(r["feature"], r["p"]): r["q"] for r in
          exact_quantiles(long, "v", ["feature"], [winsor, 1.0 - winsor]).collect()}
    rule_cols = [f"_rule_{i}" for i in range(len(rules))]
    lin_cols = [f"_lin_{i}" for i in range(len(cols))]
    exprs = [f"CASE WHEN {_rule_sql(c, cols)} THEN 1.0D ELSE 0.0D END AS {n}" for c, n in zip(rules, rule_cols)]
    exprs += [f"least(greatest(CAST(`{c}` AS DOUBLE), {qs[(c, winsor)]!r}), {qs[(c, 1.0 - winsor)]!r}) AS {n}"
              for c, n in zip(cols, lin_cols)]
    stmt = "SELECT *, " + ", ".join(exprs) + " FROM __THIS__"
    pipe = Pipeline(stages=[
        SQLTransformer(statement=stmt),
        VectorAssembler(inputCols=rule_cols + lin_cols, outputCol="features", handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0,
                           regParam=reg_param, maxIter=200)])
    model = pipe.fit(data)
    coef = model.stages[-1].coefficients.toArray().tolist()
    expanded = model.stages[0].transform(data)
    sup = expanded.agg(*[F.avg(c).alias(c) for c in rule_cols + lin_cols],
                       *[F.stddev_pop(c).alias(f"sd{c}") for c in lin_cols]).first()
    rows = []
    for i, conds in enumerate(rules):
        s = sup[rule_cols[i]]
        rows.append((_rule_text(conds), "rule", float(coef[i]), float(s), abs(coef[i]) * (s * (1 - s)) ** 0.5))
    for j, c in enumerate(cols):
        k = len(rules) + j
        rows.append((f"feature_{j}", "linear", float(coef[k]), 1.0, abs(coef[k]) * (sup[f"sd{lin_cols[j]}"] or 0.0)))
    table = spark.createDataFrame(rows, "rule string, type string, coef double, support double, importance double")
    return model, table


def predict_rulefit(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """Scores with the class-1 probability as ``prediction_score`` and the 0/1 label."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.select(*[c for c in keep if c in out.columns],
                      F.col("prediction"), vector_to_array("probability")[1].alias("prediction_score"))
