"""EX6: tree Shapley against enumeration of all subsets, and its efficiency."""

import itertools
import random
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.operators import models as ML
from lucerna.operators.treeshap import leaves_of, tree_shapley

COLS = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(150):
        v = [round(rng.random(), 2) for _ in COLS]
        out.append((i, *v, int(v[0] + v[1] * v[2] > 0.7), 3 * v[0] + v[1] * v[3]))
    return spark.createDataFrame(out, "id long, " + ", ".join(f"{c} double" for c in COLS) + ", label int, y double").repartition(3).persist()


def _score(x, leaves):
    return sum(leaf.value for leaf in leaves if all(lo < x[f] <= hi for f, lo, hi in leaf.path))


def _enumerated(x, background, leaves):
    n = len(COLS)
    value = {s: np.mean([_score([x[j] if j in s else z[j] for j in range(n)], leaves) for z in background])
             for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = []
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (value[tuple(sorted((*s, j)))] - value[s])
                       for k in range(n) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("name,task,params", [
    ("DT", "classification", {"maxDepth": 4}), ("RF", "classification", {"numTrees": 5, "maxDepth": 4}),
    ("XGBOOST", "classification", {"maxIter": 4, "maxDepth": 3}), ("XGBOOST", "regression", {"maxIter": 4, "maxDepth": 3})])
def test_tree_shapley_equals_enumeration(rows, name, task, params):
    data = rows if task == "classification" else rows.drop("label").withColumnRenamed("y", "label")
    model = ML.fit_model(data, name, task, COLS, params=params)
    background, asked = rows.where("id < 25"), rows.where("id >= 140")
    got = {}
    for r in tree_shapley(asked, background, model, COLS).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["attribution"]
    leaves = leaves_of(rows, model)
    z = [[r[c] for c in COLS] for r in background.collect()]
    scored = model.transform(data.where("id >= 140").withColumn("label", F.col("label").cast("double")))
    for r in scored.collect():
        x = [r[c] for c in COLS]
        whole = _score(x, leaves)
        if task == "regression":
            assert whole == pytest.approx(r["prediction"])
        elif name != "XGBOOST":
            assert whole == pytest.approx(r["probability"][1])
        else:
            assert whole == pytest.approx(r["rawPrediction"][1])
        mine = [got[r["id"]][c] for c in COLS]
        assert mine == pytest.approx(_enumerated(x, z, leaves), abs=1e-9)
        assert sum(mine) == pytest.approx(whole - np.mean([_score(v, leaves) for v in z]), abs=1e-9)
