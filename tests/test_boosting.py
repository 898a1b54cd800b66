"""ML4: second-order boosting against a local version that sums over rows, cut by cut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.operators import boosting as B
from lucerna.operators import models as ML

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), rng.uniform(-1, 1), float(rng.randrange(4))
        kind = int(a + b > 0) + int(c > 1 and a > 0)
        out.append((i, None if i % 9 == 0 else a, math.nan if i % 14 == 0 else b, c, float(kind > 0), float(kind), a * b + c + rng.gauss(0, 0.1), 1.0 + i % 3))
    return spark.createDataFrame(out, "id long, a double, b double, c double, two double, three double, y double, w double").repartition(5).persist()


def local_boosting(x, y, w, edges, task, classes, base, s):
    """Margins after each round: every cut of every feature tried on the rows themselves."""
    outputs = classes if classes > 2 else 1
    margin = np.full((len(y), outputs), base)
    history = []
    for _ in range(s.n_estimators):
        loss, g, h = B.gradients(margin, y, task)
        history.append((loss * w).sum() / w.sum())
        step = np.zeros_like(margin)
        for k in range(outputs):
            gk, hk = g[:, k] * w, h[:, k] * w
            score = lambda m, gk=gk, hk=hk: s.quality(gk[m].sum(), hk[m].sum())
            work = [(np.ones(len(y), bool), 0)]
            while work:
                node, depth = work.pop()
                best = (B.LEAST_GAIN, None)
                if depth < s.max_depth:
                    for j in range(x.shape[1]):
                        for missing_left in (False, True):
                            for cut in [*edges[j], math.inf]:
                                left = node & np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= cut)
                                right = node & ~left
                                if min(hk[left].sum(), hk[right].sum()) < max(s.min_child_weight, 1e-12):
                                    continue
                                gain = (score(left) + score(right) - score(node)) / 2 - s.gamma
                                if gain > best[0] + 1e-12:
                                    best = (gain, (left, right))
                if best[1] is None:
                    step[node, k] = s.leaf(gk[node].sum(), hk[node].sum())
                else:
                    work += [(part, depth + 1) for part in best[1]]
        margin = margin + step
    loss, _, _ = B.gradients(margin, y, task)
    return margin, [*history, (loss * w).sum() / w.sum()]


@pytest.mark.parametrize("label,task,classes,extra", [
    ("two", "classification", 2, {"gamma": 0.1, "alpha": 0.2}), ("three", "classification", 3, {}),
    ("y", "regression", 2, {"reg_lambda": 0.5, "min_child_weight": 4.0})])
def test_equals_a_local_version(rows, label, task, classes, extra):
    settings = {"n_estimators": 5, "max_depth": 3, "max_bin": 16, "rewrite": 2, **extra}
    model = B.fit_boosted(rows, COLS, task, classes, label, "w", **settings)
    data = np.array(rows.select(*COLS, label, "w").orderBy("id").collect(), float)
    x, y, w = data[:, :3], data[:, 3], data[:, 4]
    want, history = local_boosting(x, y, w, model.edges, task, classes, model.base, B.Boosting(**settings))
    got = model.pipeline().transform(rows).orderBy("id").select("prediction", *(["probability"] if task == "classification" else [])).collect()
    assert np.allclose(model.history, history, atol=1e-9)
    if task == "regression":
        assert np.allclose([r["prediction"] for r in got], want[:, 0], atol=1e-9)
        return
    if classes == 2:
        want = np.column_stack([np.zeros(len(want)), want[:, 0]])
    chance = np.exp(want) / np.exp(want).sum(1, keepdims=True)
    assert np.allclose([r["probability"] for r in got], chance, atol=1e-9)
    assert [r["prediction"] for r in got] == list(chance.argmax(1))


@pytest.mark.parametrize("label,task,classes", [("two", "classification", 2), ("three", "classification", 3), ("y", "regression", 2)])
def test_loss_falls_each_round_and_a_saved_model_scores_alike(rows, tmp_dir, label, task, classes):
    model = B.fit_boosted(rows, COLS, task, classes, label, n_estimators=12, max_depth=4)
    assert len(model.history) == 13 and all(b < a for a, b in zip(model.history, model.history[1:], strict=False))
    ML.save_model(model.pipeline(), f"{tmp_dir}/m")
    a, b = (ML.predict(m, rows).orderBy("id").collect() for m in (model.pipeline(), ML.load_model(f"{tmp_dir}/m")))
    assert a == b


def test_result_does_not_depend_on_the_partitions(rows):
    few = B.fit_boosted(rows.coalesce(1), COLS, "classification", 2, "two", n_estimators=3, subsample=0.6)
    many = B.fit_boosted(rows.repartition(9), COLS, "classification", 2, "two", n_estimators=3, subsample=0.6)
    all_rows = B.fit_boosted(rows, COLS, "classification", 2, "two", n_estimators=3)
    assert np.allclose(few.history, many.history, atol=1e-12) and not np.allclose(few.history, all_rows.history, atol=1e-6)


def test_odd_inputs(spark, rows):
    with pytest.raises(ValueError, match="no row"):
        B.fit_boosted(rows.limit(0), COLS, label="two")
    with pytest.raises(ValueError, match="whole numbers"):
        B.fit_boosted(rows, COLS, "classification", 2, "three")
    with pytest.raises(ValueError, match="out of range"):
        B.Boosting(subsample=0)
    one = rows.withColumn("two", F.lit(1.0)).withColumn("nothing", F.lit(None).cast("double"))
    model = B.fit_boosted(one, ["nothing"], "classification", 2, "two", n_estimators=3)
    assert model.pipeline().transform(one).where("prediction <> 1").count() == 0
    unlabelled = rows.withColumn("two", F.when(F.col("id") > 20, F.col("two")))
    a = B.fit_boosted(unlabelled, COLS, label="two", n_estimators=2)
    b = B.fit_boosted(rows.where("id > 20"), COLS, label="two", n_estimators=2)
    assert np.allclose(a.history, b.history, atol=1e-12)


def test_family_is_offered_by_fit_model(rows):
    model = ML.fit_model(rows, "HGB", "classification", COLS, 3, {"n_estimators": 4}, "three")
    out = ML.predict(model, rows, ("id",))
    assert out.columns == ["id", "prediction", "probability"]
    assert out.select(F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, p: s + p) - 1))).first()[0] < 1e-9
