"""Queries for model families (ML), voting (ML12-ML17, ML20), search (HS) and fold runs (CV7).

Voting arithmetic is deterministic and SQL-checked over the rule models of
``model_votes``; fitted models are registered rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import folds as CV
from lucerna.operators import models as ML
from lucerna.operators import sample as SA
from lucerna.operators import search as HS
from lucerna.operators import voting as VO
from lucerna.operators.boosting import fit_boosted
from lucerna.operators.network import fit_network
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, with_views

_MW = "(VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in VO.METRIC_WEIGHTS.items()) + ") mw(metric, w)"
_WEIGHTS = f"""
sc AS (SELECT m.model, coalesce(s.score, 0.0) AS score
       FROM (SELECT DISTINCT model FROM run_metrics) m
       LEFT JOIN (SELECT r.model, sum(mw.w * r.value) AS score FROM run_metrics r
                  JOIN {_MW} ON r.metric = mw.metric GROUP BY r.model) s ON m.model = s.model),
rk AS (SELECT model, score, row_number() OVER (ORDER BY score DESC, model) AS rank FROM sc),
wt AS (SELECT model, score, CAST(rank AS BIGINT) AS rank, (1.0 / rank) / sum(1.0 / rank) OVER () AS weight FROM rk)"""


def _weights(v):
    return VO.model_weights(v.run_metrics.select("model", "metric", "value"))


@query("ml_vote_weights", "ML12", with_views(
    f"SELECT * FROM (WITH {_WEIGHTS} SELECT model, {R('score')} AS score, rank, {R('weight')} AS weight FROM wt) q",
    "run_metrics"))
def ml_vote_weights(v):
    w = _weights(v)
    return w.select("model", rnd("score").alias("score"), "rank", rnd("weight").alias("weight"))


@query("ml_vote_class", "ML13", with_views(f"""
SELECT * FROM (WITH {_WEIGHTS},
     pv AS (SELECT v.id, v.prediction, sum(wt.weight) AS w FROM model_votes v JOIN wt ON v.model = wt.model
            GROUP BY 1, 2),
     b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, prediction) AS r FROM pv)
SELECT id, prediction, {R('w')} AS vote_weight FROM b WHERE r = 1) q""", "run_metrics", "model_votes"))
def ml_vote_class(v):
    out = VO.weighted_class_vote(v.model_votes, _weights(v))
    return out.select("id", "prediction", rnd("vote_weight").alias("vote_weight"))


@query("ml_vote_regression", "ML14", with_views(f"""
SELECT * FROM (WITH {_WEIGHTS}
SELECT v.id, {R('sum(wt.weight * v.probability) / sum(wt.weight)')} AS prediction
FROM model_votes v JOIN wt ON v.model = wt.model GROUP BY v.id) q""", "run_metrics", "model_votes"))
def ml_vote_regression(v):
    votes = v.model_votes.select("id", "model", F.col("probability").alias("prediction"))
    out = VO.weighted_regression(votes, _weights(v))
    return out.select("id", rnd("prediction").alias("prediction"))


@query("ml_vote_probability", "ML15", with_views(f"""
SELECT id, class, {R('avg(p)', 9)} AS probability FROM (
  SELECT id, 0 AS class, 1.0 - probability AS p FROM model_votes
  UNION ALL SELECT id, 1 AS class, probability AS p FROM model_votes) t GROUP BY 1, 2""", "model_votes"))
def ml_vote_probability(v):
    out = VO.mean_probability(v.model_votes)
    # a mean of four 6-decimal values has at most 8 decimals: 9 digits never tie
    return out.select("id", "class", rnd("probability", 9).alias("probability"))


@query("ml_probability_fallback", "ML16", with_views(
    "SELECT id, model, CAST(1 - prediction AS DOUBLE) AS p0, CAST(prediction AS DOUBLE) AS p1 FROM model_votes",
    "model_votes"))
def ml_probability_fallback(v):
    p = F.col("prediction").cast("double")
    return v.model_votes.select("id", "model", (1.0 - p).alias("p0"), p.alias("p1"))


@query("ml_batch_scores", "ML17", with_views("""
SELECT id AS "Sample ID",
       CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS "Predicted class",
       greatest(p0, p1, p2) AS "Probability" FROM order_pred_multi""", "order_pred_multi"))
def ml_batch_scores(v):
    return ML.batch_scores(v.order_pred_multi, "classification")


@query("ml_batch_scores_regression", "ML17", with_views("""
SELECT id AS "Sample ID", -1 AS "Predicted class", prediction AS "Probability" FROM order_pred_reg""",
    "order_pred_reg"))
def ml_batch_scores_regression(v):
    return ML.batch_scores(v.order_pred_reg, "regression")


@query("ml_rulefit_hard_label", "ML20", with_views(
    "SELECT id, CAST(trunc(sign(probability) * floor(abs(probability) * 100.0 + 0.5) / 100.0) AS INTEGER) "
    "AS hard_label FROM order_pred", "order_pred"))
def ml_rulefit_hard_label(v):
    return ML.rulefit_hard_label(v.order_pred.select("id", "probability"), "probability").select("id", "hard_label")


# ---------------------------------------------------------------- fitted models (rows-only)

def _split(v, df=None):
    # the split feeds a fit and a scoring pass: materialise it once
    s = SA.train_test_split(df if df is not None else v.order_binary).persist()
    return s.where("split = 'train'"), s.where("split = 'test'")


def _fit_score(v, name, task="classification", params=None, df=None, n_classes=2):
    train, test = _split(v, df)
    m = ML.fit_model(train, name, task, FEATURES, n_classes=n_classes, params=params)
    return ML.predict(m, test)


@query("ml_decision_tree", "ML1")
def ml_decision_tree(v):
    return _fit_score(v, "DT", params={"maxDepth": 5})


@query("ml_decision_tree_regression", "ML1")
def ml_decision_tree_regression(v):
    return _fit_score(v, "DT", "regression", df=v.order_regression)


@query("ml_random_forest", "ML2")
def ml_random_forest(v):
    return _fit_score(v, "RF")


def _svm(v, view, task="classification", params=None):
    from lucerna.operators.scale import normalise
    train, test = _split(v, normalise(view, FEATURES, "SC", "id"))
    return ML.predict(ML.fit_model(train, "SVM", task, FEATURES, params=params), test)


@query("ml_svm_rbf", "ML3")
def ml_svm_rbf(v):
    return _svm(v, v.order_binary)


@query("ml_svm_poly", "ML3")
def ml_svm_poly(v):
    return _svm(v, v.order_binary, params={"kernel": "poly", "degree": 3, "coef0": 1.0})


@query("ml_svm_sigmoid", "ML3")
def ml_svm_sigmoid(v):
    return _svm(v, v.order_binary, params={"kernel": "sigmoid", "gamma": 0.05})


@query("ml_svm_regression", "ML3")
def ml_svm_regression(v):
    return _svm(v, v.order_regression, "regression").select("id", "label", "prediction")


@query("ml_gradient_boosting", "ML4")
def ml_gradient_boosting(v):
    return _fit_score(v, "XGBOOST", params={"maxIter": 20, "maxDepth": 4})


@query("ml_second_order_boosting", "ML4")
def ml_second_order_boosting(v):
    return _fit_score(v, "HGB")


@query("ml_second_order_boosting_multiclass", "ML4")
def ml_second_order_boosting_multiclass(v):
    return _fit_score(v, "HGB", df=v.order_multi, n_classes=3, params={"subsample": 0.5, "eta": 0.5, "n_estimators": 30})


@query("ml_boosting_history", "ML4,ML22")
def ml_boosting_history(v):
    train, _ = _split(v, v.order_regression)
    history = fit_boosted(train, FEATURES, "regression", n_estimators=30).history
    return v.spark.createDataFrame(list(enumerate(history)), "iteration int, objective double")


@query("ml_neural_network", "ML5")
def ml_neural_network(v):
    from lucerna.operators.scale import normalise
    std = normalise(v.order_multi, FEATURES, "SC", "id")
    return _fit_score(v, "ANN", df=std, n_classes=3)


@query("ml_dense_network", "ML5")
def ml_dense_network(v):
    return _fit_score(v, "DNN", df=v.order_multi, n_classes=3, params={"hidden": [32, 16], "dropout": 0.1})


@query("ml_dense_network_regression", "ML5")
def ml_dense_network_regression(v):
    return _fit_score(v, "DNN", "regression", df=v.order_regression).select("id", "label", "prediction")


@query("ml_dense_network_history", "ML5,ML22")
def ml_dense_network_history(v):
    train, _ = _split(v)
    history = fit_network(train, FEATURES, hidden=[16], activation="tanh", optimizer="rmsprop").history
    return v.spark.createDataFrame(list(enumerate(history)), "epoch int, loss double")


@query("ml_logistic_regression", "ML9,ML16")
def ml_logistic_regression(v):
    return _fit_score(v, "LR")


@query("ml_linear_regression", "ML9")
def ml_linear_regression(v):
    return _fit_score(v, "LR", "regression", df=v.order_regression)


@query("ml_bagging", "ML10")
def ml_bagging(v):
    return _fit_score(v, "BAG")


@query("ml_tree_leaves", "ML21")
def ml_tree_leaves(v):
    train, test = _split(v)
    m = ML.fit_model(train, "DT", "classification", FEATURES, params={"maxDepth": 4})
    return ML.leaf_statistics(m, test.withColumn("label", F.col("label").cast("double")))


@query("ml_learning_history", "ML22")
def ml_learning_history(v):
    train, _ = _split(v)
    m = ML.fit_model(train, "LR", "classification", FEATURES)
    return ML.learning_history_df(v.spark, m)


@query("hs_random_search", "HS2,HS4,CV6")
def hs_random_search(v):
    train, _ = _split(v)
    folded = CV.group_kfold(train)
    _, trials = HS.search(folded, "DT", "classification", FEATURES,
                          {"maxDepth": [2, 4, 6, 8], "minInstancesPerNode": [1, 5]}, n_iter=4)
    return trials


@query("hs_grid_search", "HS1")
def hs_grid_search(v):
    train, _ = _split(v, v.order_regression)
    folded = CV.kfold(train)
    _, trials = HS.search(folded, "LR", "regression", FEATURES, {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]})
    return trials


@query("hs_trial_metrics", "HS4")
def hs_trial_metrics(v):
    train, _ = _split(v, v.order_regression)
    trials = HS.combinations({"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 1.0]})
    return HS.trial_metrics(CV.kfold(train), "LR", "regression", FEATURES, trials)


@query("hs_bayesian", "HS3")
def hs_bayesian(v):
    train, _ = _split(v)
    space = {"maxDepth": HS.Whole(1, 8), "minInstancesPerNode": HS.Whole(1, 50), "minInfoGain": HS.Real(1e-5, 1e-1, log=True),
             "impurity": HS.Choice(("gini", "entropy"))}
    _, trials = HS.bayesian_search(CV.stratified_kfold(train), "DT", "classification", FEATURES, space)
    return trials


@query("hs_hyperband", "HS3,ML5")
def hs_hyperband(v):
    from lucerna.operators.scale import normalise
    std = normalise(v.order_multi, FEATURES, "SC", "id")
    train, _ = _split(v, std)
    _, trials = HS.hyperband(CV.stratified_kfold(train), "ANN", "classification", FEATURES, HS.ANN_SPACE, n_classes=3)
    return trials


@query("cv_run_folds", "CV7,CV5")
def cv_run_folds(v):
    train, _ = _split(v)
    return HS.run_folds(CV.stratified_kfold(train), "LR", "classification", FEATURES)


@query("ml_voting_ensemble", "ML11,ML12,ML13,ML15")
def ml_voting_ensemble(v):
    from lucerna.operators.voting import fit_voting
    train, test = _split(v)
    res = fit_voting(train, test, ["DT", "LR", "BAG"], FEATURES)
    return res["vote"].join(res["probability"].where("class = 1").select("id", "probability"), "id")


@query("ml_voting_saved", "ML11,IO9")
def ml_voting_saved(v):
    import uuid

    from lucerna.session import scratch_path
    train, test = _split(v)
    folder = scratch_path(v.spark, f"models-{uuid.uuid4().hex}")
    VO.save_models({f"{n}_orders": ML.fit_model(train, n, "classification", FEATURES) for n in ("DT", "LR")}, folder)
    return VO.vote(VO.load_models(v.spark, folder, ["DT", "LR", "RF"]), test)["vote"]


def _rulefit(v):
    from lucerna.operators.rulefit import fit_rulefit
    train, test = _split(v)
    model, table = fit_rulefit(train, FEATURES)
    return model, table, test


@query("ml_rulefit", "ML7,ML20")
def ml_rulefit(v):
    from lucerna.operators.rulefit import predict_rulefit
    model, _, test = _rulefit(v)
    scored = predict_rulefit(model, test)
    return ML.rulefit_hard_label(scored, "prediction_score")


@query("ml_rulefit_rules", "ML7,ML18")
def ml_rulefit_rules(v):
    from lucerna.operators.rules import rulefit_table
    _, table, _ = _rulefit(v)
    return rulefit_table(table, FEATURES)


def _ripper(v):
    from lucerna.operators.ripper import fit_ripper
    train, test = _split(v)
    return fit_ripper(train, FEATURES), test


@query("ml_ripper", "ML8")
def ml_ripper(v):
    from lucerna.operators.ripper import predict_ripper
    model, test = _ripper(v)
    return predict_ripper(model, test)


@query("ml_ripper_rules", "ML8,ML19")
def ml_ripper_rules(v):
    from lucerna.operators.ripper import ripper_rules_table
    model, _ = _ripper(v)
    return ripper_rules_table(v.spark, model)


@query("ml_ripper_history", "ML8")
def ml_ripper_history(v):
    from lucerna.operators.ripper import ripper_history
    model, _ = _ripper(v)
    return ripper_history(v.spark, model)


@query("hs_ann_halving", "HS3,ML5")
def hs_ann_halving(v):
    from lucerna.operators.scale import normalise
    std = normalise(v.order_multi, FEATURES, "SC", "id")
    train, _ = _split(v, std)
    return HS.successive_halving_mlp(CV.stratified_kfold(train), FEATURES, 3)


@query("ml_neural_network_regression", "ML5,ML22")
def ml_neural_network_regression(v):
    from lucerna.operators.mlp import fit_mlp_regressor, mlp_predict
    from lucerna.operators.scale import normalise
    std = normalise(v.order_regression, FEATURES, "SC", "id")
    train, test = _split(v, std)
    model = fit_mlp_regressor(train, FEATURES)
    return mlp_predict(model, test)
