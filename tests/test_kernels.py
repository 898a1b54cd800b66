"""ML3: kernel maps against dense kernels, support-vector regression against its optimality conditions."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from lucerna.operators import kernels as K
from lucerna.operators import models as ML


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for i in range(160):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        out.append((i, a, b, float(a * b > 0), 2 * a * a - b + rng.gauss(0, 0.02)))
    return spark.createDataFrame(out, "id long, a double, b double, label double, y double").repartition(3).persist()


@pytest.mark.parametrize("kernel,args", [("poly", {"degree": 3, "coef0": 1.0, "gamma": 0.5}), ("sigmoid", {"gamma": 0.3})])
def test_nystroem_map_gives_the_kernel(rows, kernel, args):
    """With every row a landmark, inner products of the mapped rows are the kernel (its positive form)."""
    statement, names = K.nystroem_statement(rows, ["a", "b"], kernel, n_components=160, **args)
    got = SQLTransformer(statement=statement).transform(rows).orderBy("id")
    assert "_map" not in got.columns and set(rows.columns) < set(got.columns)
    z = np.array(got.select(*names).collect(), float)
    x = np.array(got.select("a", "b").collect(), float)
    full = {"coef0": 0.0, "degree": 3, **args}
    k = K.kernel_matrix(x, x, kernel, full["gamma"], full["coef0"], full["degree"])
    value, vector = np.linalg.eigh(k)
    assert np.abs(z @ z.T - (vector * np.abs(value)) @ vector.T).max() < 1e-5


def test_fourier_features_approximate_the_rbf_kernel(rows):
    statement, names = K.fourier_statement(["a", "b"], 400, 0.5, 3)
    got = SQLTransformer(statement=statement).transform(rows).limit(30)
    z, x = (np.array(got.select(*c).collect(), float) for c in (names, ["a", "b"]))
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.25


@pytest.mark.parametrize("kernel", ["poly", "sigmoid", "rbf"])
def test_kernels_classify_what_a_line_cannot(rows, kernel, tmp_dir):
    params = {"kernel": kernel, "n_components": 40, **({"coef0": 1.0, "degree": 2} if kernel == "poly" else {"gamma": 1.0})}
    model = ML.fit_model(rows, "SVM", "classification", ["a", "b"], params=params)
    accuracy = lambda m: m.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    line = ML.fit_model(rows, "SVM", "classification", ["a", "b"], params={"kernel": "linear"})
    assert accuracy(model) > (0.9 if kernel != "sigmoid" else 0.7) > accuracy(line)
    ML.save_model(model, f"{tmp_dir}/svm")
    assert accuracy(ML.load_model(f"{tmp_dir}/svm")) == accuracy(model)


def test_support_vector_regression_is_optimal(rows):
    """At the minimum the gradient vanishes; no direction lowers the objective."""
    c, epsilon = 5.0, 0.1
    w = K.support_vector_regression(rows, ["a", "b"], "y", c, epsilon)
    x = np.hstack([np.array(rows.select("a", "b").collect(), float), np.ones((160, 1))])
    y = np.array([r[0] for r in rows.select("y").collect()])

    def objective(v):
        return v[:2] @ v[:2] / 2 + c * (np.maximum(np.abs(x @ v - y) - epsilon, 0) ** 2).sum()
    rng = np.random.default_rng(1)
    best = objective(w)
    assert all(objective(w + d * s) >= best - 1e-9 for d in rng.normal(size=(50, 3)) for s in (1e-3, -1e-3, 0.1, -0.1))


def test_svr_with_a_kernel_fits_a_curve(rows):
    data = rows.drop("label").withColumnRenamed("y", "label")
    model = ML.fit_model(data, "SVM", "regression", ["a", "b"], params={"kernel": "poly", "degree": 2, "coef0": 1.0, "c": 10.0, "epsilon": 0.05})
    worst = model.transform(data).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert worst < 0.25


def test_kernel_map_stage_equals_the_statement(rows):
    """The Arrow stage and the SQL statement are one map; a row with a null has none."""
    from pyspark.ml.functions import vector_to_array
    data = rows.unionByName(rows.limit(1).selectExpr("-1L AS id", *[("CAST(NULL AS DOUBLE) AS a" if c == "a" else c) for c in rows.columns if c != "id"]))
    for stage, (statement, names) in [
            (K.KernelMap.fourier(["a", "b"], 0.5, 20, 3), K.fourier_statement(["a", "b"], 20, 0.5, 3)),
            (K.KernelMap.nystroem(rows, ["a", "b"], "poly", 15, coef0=1.0), K.nystroem_statement(rows, ["a", "b"], "poly", 15, coef0=1.0))]:
        want = {r["id"]: [r[n] for n in names] for r in SQLTransformer(statement=statement).transform(data).collect()}
        arrays = {r["id"]: r["m"] for r in stage.arrays("m").transform(data).collect()}
        vectors = {r["id"]: r["v"] for r in stage.transform(data).select("id", vector_to_array("features").alias("v")).collect()}
        assert arrays.pop(-1) is None and np.isnan(vectors.pop(-1)).all() and set(want.pop(-1)) == {None}
        assert all(np.allclose(arrays[i], w, atol=1e-6) and np.allclose(vectors[i], w, atol=1e-6) for i, w in want.items())


def test_svm_pipelines_hold_no_interpreted_map(rows):
    """Higher-order SQL over 100 landmarks took minutes: the fitted pipelines map batches."""
    for task, label in (("classification", "label"), ("regression", "a")):
        model = ML.fit_model(rows, "SVM", task, ["a", "b"], label=label, params={"kernel": "poly", "n_components": 10})
        assert isinstance(model.stages[0], K.KernelMap)
