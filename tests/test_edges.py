"""Edge cases: far queries, numeric targets, chained balancing, text ids, nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lucerna.operators import folds, neighbours, prep, rules, sample, scale
from lucerna.operators.explain import expr_scorer, permutation_importance
from lucerna.plans.fixtures import FEATURES, Views


def test_knn_inside_at_the_edge_and_far_outside(spark):
    rng = np.random.default_rng(4)
    base = rng.random((400, 2))
    query = np.concatenate([rng.random((20, 2)), [[0, 0], [1, 1], [2.6, 0.5], [5, 5], [-30, 0.2], [0.5, 400]]])
    b = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": base[:, 0], "y": base[:, 1]}))
    q = spark.createDataFrame(pd.DataFrame({"id": range(1000, 1000 + len(query)), "x": query[:, 0], "y": query[:, 1]}))
    got = neighbours.knn(q, b, ["x", "y"], 5).toPandas()
    assert got.groupby("qid").size().tolist() == [5] * len(query)
    for i, p in enumerate(query):
        best = sorted((float(np.hypot(*(p - v))), j) for j, v in enumerate(base))[:5]
        mine = got[got.qid == 1000 + i].sort_values("rank")
        assert mine.nid.tolist() == [j for _, j in best]


def test_numeric_target_is_coded_in_number_order(spark):
    df = spark.createDataFrame([(1, 10), (2, 2), (3, 1), (4, None), (5, 10)], "id int, target int")
    got = {r["id"]: r["target"] for r in prep.encode_target(df, "target").collect()}
    assert got == {1: 2, 2: 1, 3: 0, 5: 2}


def test_chained_balancing_has_distinct_ids_and_flags(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.random(2)), 0 if i < 60 else 1 if i < 75 else 2) for i in range(85)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    for methods in (["ADASYN", "ROS"], ["SMOTE", "ROS"]):
        out = sample.balance(df, methods, feature_cols=["a", "b"]).toPandas()
        assert out.id.is_unique
        assert (out.synthetic == (out.id < 0)).all()
        assert out.groupby("label").size().nunique() == 1


def test_polynomial_chain_leaves_the_label(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7), float(i % 2)) for i in range(20)],
                               "id long, a double, b double, label double")
    out = scale.normalise(df, ["a", "b"], ["PF", "SC"], "id")
    assert {r["id"]: r["label"] for r in out.collect()} == {i: float(i % 2) for i in range(20)}
    names = scale.feature_names_after(["a", "b"], ["PF", "SC"])
    assert set(names) == set(out.columns) - {"id", "label"}
    assert abs(out.agg(F.avg("`a b`")).first()[0]) < 1e-9


def test_flow_accuracy_of_three_classes(spark, sf_small):
    from lucerna.plans.flow import train_evaluate_explain
    res = train_evaluate_explain(Views(spark, sf_small).order_multi, FEATURES, model_name="DT")
    share = res["predictions"].agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    metric = {r["metric"]: r["value"] for r in res["metrics"].collect()}["Accuracy"]
    assert float(metric) == pytest.approx(100 * share, abs=0.01)


def test_folds_of_text_ids_and_null_labels(spark):
    df = spark.createDataFrame([(f"id{i:04d}", None if i % 3 == 0 else i % 2) for i in range(100)], "id string, label int")
    assert folds.kfold(df, k=5).groupBy("fold").count().toPandas()["count"].tolist() == [20] * 5
    assert folds.stratified_kfold(df, k=5).count() == 100


def test_rule_numbers_with_exponents(spark):
    df = spark.createDataFrame([("s", "0<=1e-05 ^ 1>2.5E+3")], "source string, text string")
    got = {r["feature"]: r["value"] for r in rules.parse_rules(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(1e-5, abs=2e-5)
    assert got["b"] == pytest.approx(2500, abs=1e-3)


def test_svm_kernels_that_are_not_offered_raise(spark):
    from lucerna.operators.models import fit_model
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 1.0)], "id int, a double, label double")
    with pytest.raises(ValueError, match="precomputed"):
        fit_model(df, "SVM", "classification", ["a"], params={"kernel": "precomputed"})


def test_every_repeat_is_a_permutation_of_its_own(spark):
    rows = [(i, float(i % 10), float(i % 3), int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    sc = expr_scorer(lambda: F.when(F.col("a") > 4.5, 1.0).otherwise(0.0))
    got = {r["feature"]: r for r in permutation_importance(df, ["a", "b"], sc, repeats=5).collect()}
    assert got["a"]["std"] > 0 and got["a"]["attribution"] > 0.3
    assert got["b"]["attribution"] == 0 and got["b"]["std"] == 0


def test_ridge_from_sums_equals_direct_fit():
    import numpy as np
    import pandas as pd
    from lucerna.functions.local_fit import ridge_from_sums
    rng = np.random.default_rng(3)
    rows, want = [], []
    for d_rows in (40, 200):
        z = rng.integers(0, 2, (d_rows, 3)).astype(float)
        y, w = rng.normal(size=d_rows), rng.uniform(0.1, 1.0, d_rows)
        x = np.column_stack([np.ones(d_rows), z])
        beta = np.linalg.solve((x * w[:, None]).T @ x + np.diag([0.0, 1.0, 1.0, 1.0]), (x * w[:, None]).T @ y)
        want.append([*beta[1:], beta.sum()])
        rows.append([w.sum(), (w * y).sum(), *(w @ z), *((w * y) @ z),
                     *[(w * z[:, i] * z[:, j]).sum() for i in range(3) for j in range(i, 3)]])
    got = ridge_from_sums(3)(*[pd.Series(c) for c in np.array(rows).T])
    assert np.allclose(got.to_numpy(), want)


def test_integrated_gradients_of_any_scorer_complete_and_null_safe(spark):
    from pyspark.sql import functions as F
    from lucerna.operators import explain as EX
    rows = spark.createDataFrame([("a", 1.0, 4.0), ("b", -2.0, 0.5), ("c", 0.0, None)], "id string, x double, y double")
    score = EX.expr_scorer(lambda: F.col("x") * F.col("x") * F.col("y") + F.col("y"))
    out = EX.integrated_gradients(rows, {"x": 0.5, "y": 1.0}, ["x", "y"], score).collect()
    total = {}
    for r in out:
        total.setdefault(r["id"], []).append(r["attribution"])
    base = 0.25 + 1.0
    assert abs(sum(total["a"]) - (4.0 + 4.0 - base)) < 1e-2      # trapezoid rule with 50 steps
    assert abs(sum(total["b"]) - (2.0 + 0.5 - base)) < 1e-2
    assert total["c"] == [None, None]


def test_custom_consensus_flat_file_and_missing_quality(spark):
    from lucerna.operators import consensus as CO
    rows = [("m", "g1", None, "f1", 0.5, None), ("m", "g1", None, "f2", 0.5, None),
            ("m", "l1", 7, "f1", -1.0, 0.5), ("m", "l1", 7, "f2", 3.0, 0.5), ("n", "g1", None, "f1", 1.0, None)]
    attr = spark.createDataFrame(rows, "model string, method string, sample_id long, feature string, "
                                       "attribution double, probability double")
    q = spark.createDataFrame([("m", 1.0)], "model string, metric double")
    got = {(r["model"], r["feature"]): r["attribution"] for r in CO.custom(attr, q).collect()}
    # global rows are all equal (0); locals scale to 0 and 1, over two local rows, times probability
    assert got == {("m", "f1"): 0.0, ("m", "f2"): 0.25}
