"""ML5: dense networks: gradients against difference quotients, fits, dropout, saving."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.operators import models as ML
from lucerna.operators import network as N

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(400):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        out.append((i, a, None if i % 50 == 0 else b, float(a * b > 0), float((a > 0) + (b > 0.3)), 3 * a * a + 100.0))
    return spark.createDataFrame(out, "id long, a double, b double, two double, three double, y double").repartition(3).persist()


@pytest.mark.parametrize("activation", sorted(N.ACTIVATIONS))
@pytest.mark.parametrize("task,classes", [("classification", 2), ("classification", 4), ("regression", 2)])
def test_gradient_equals_difference_quotients(activation, task, classes):
    rng = np.random.default_rng(1)
    net = N.Network(["p", "q", "r"], task, classes, [5, 4], activation, [0.0] * 3, [1.0] * 3)
    size = sum(a * b + b for a, b in zip(net.sizes[:-1], net.sizes[1:], strict=True))
    weights, x, w = rng.normal(0, 0.7, size), rng.normal(size=(20, 3)), rng.uniform(0.5, 2, 20)
    y = rng.normal(size=20) if task == "regression" else rng.integers(0, classes, 20).astype(float)
    masks = [(rng.random((20, s)) > 0.3) / 0.7 for s in net.hidden]
    for m in (None, masks):
        _, got = net.loss_and_gradient(x, y, w, weights, m)
        want = np.empty(size)
        for i in range(size):
            e = np.zeros(size)
            e[i] = 1e-6
            want[i] = (net.loss_and_gradient(x, y, w, weights + e, m)[0] - net.loss_and_gradient(x, y, w, weights - e, m)[0]) / 2e-6
        assert np.abs(got - want).max() < 1e-5


def test_learns_what_no_linear_model_can(rows, tmp_dir):
    model = ML.fit_model(rows, "DNN", "classification", COLS, params={"hidden": [12, 8], "epochs": 25, "batches": 3, "learning_rate": 0.03}, label="two")
    out = ML.predict(model, rows, ("id", "two"))
    assert out.where("prediction = two").count() > 0.93 * rows.count()
    ML.save_model(model, f"{tmp_dir}/net")
    assert ML.predict(ML.load_model(f"{tmp_dir}/net"), rows).orderBy("id").collect() == ML.predict(model, rows).orderBy("id").collect()


def test_regression_by_the_common_path(rows):
    model = ML.fit_model(rows, "ANN", "regression", COLS, params={"hidden": [12], "activation": "tanh", "epochs": 30, "batches": 2, "learning_rate": 0.05}, label="y")
    r = model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("e"), F.var_pop("y").alias("v")).first()
    assert r["e"] < 0.1 * r["v"]


@pytest.mark.parametrize("optimizer", N.OPTIMIZERS)
def test_every_optimiser_lowers_the_loss(rows, optimizer):
    net = N.fit_network(rows, COLS, "classification", 3, "three", hidden=[8], optimizer=optimizer, epochs=8, batches=2, learning_rate=0.05, l2=1e-4)
    assert len(net.history) == 8 and net.history[-1] < 0.8 * net.history[0]


def test_result_depends_on_rows_and_seed_alone(rows):
    args = {"label": "two", "hidden": [6], "epochs": 2, "dropout": 0.3}
    a = N.fit_network(rows.coalesce(1), COLS, **args)
    b = N.fit_network(rows.repartition(7), COLS, **args)
    assert np.allclose(a.weights, b.weights, atol=1e-10)
    assert not np.allclose(a.weights, N.fit_network(rows, COLS, **{**args, "dropout": 0.0}).weights, atol=1e-4)


def test_odd_inputs(spark, rows):
    with pytest.raises(ValueError, match="no row"):
        N.fit_network(rows.limit(0), COLS, label="two")
    with pytest.raises(ValueError, match="whole numbers"):
        N.fit_network(rows, COLS, "classification", 2, "three")
    with pytest.raises(ValueError, match="out of range"):
        N.fit_network(rows, COLS, label="two", activation="step")
    few = rows.where("id < 3").withColumn("nothing", F.lit(None).cast("double")).withColumn("_margin", F.lit(1))
    model = N.fit_network(few, ["a", "nothing"], label="two", epochs=2, batches=8).pipeline()
    out = model.transform(few)
    assert set(few.columns) < set(out.columns) and out.where("prediction is null or isnan(probability[0])").count() == 0
