"""EX1 with the scorers of the reference tasks, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lucerna.operators import explain as EX


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = [(i, rng.randrange(5) / 2, rng.random(), rng.random()) for i in range(120)]
    return spark.createDataFrame([(i, a, b, c, int(a + b > 1.6), int(a + b), a * 2 + b) for i, a, b, c in out],
                                 "id long, a double, b double, c double, label int, kind int, y double").repartition(3)


def test_default_scoring():
    assert EX.default_scoring("regression") == "r2" and EX.default_scoring("classification", 3) == "neg_log_loss"
    assert EX.default_scoring("classification") == "roc_auc"


def test_metrics_equal_plain_python(rows):
    scored = rows.withColumn("score", F.col("a") + F.col("b") / 10)
    (m,) = EX._scored_metric(scored, "roc_auc", "label", []).collect()
    data = [(r["score"], r["label"]) for r in scored.collect()]
    pairs = [(p > n) + (p == n) / 2 for p, y in data if y for n, z in data if not z]
    assert m["_m"] == pytest.approx(sum(pairs) / len(pairs))
    by = {r["_g"]: r["_m"] for r in EX._scored_metric(scored.withColumn("_g", F.col("id") % 2), "roc_auc", "label", ["_g"]).collect()}
    for g in (0, 1):
        part = [(r["score"], r["label"]) for r in scored.where(F.col("id") % 2 == g).collect()]
        pairs = [(p > n) + (p == n) / 2 for p, y in part if y for n, z in part if not z]
        assert by[g] == pytest.approx(sum(pairs) / len(pairs))
    probs = rows.withColumn("probability", F.array(F.lit(0.7), F.lit(0.3), F.lit(0.0), F.lit(0.0)))
    (m,) = EX._scored_metric(probs, "neg_log_loss", "kind", []).collect()
    want = [math.log(max((0.7, 0.3, 0.0, 0.0)[r["kind"]], 1e-15)) for r in rows.collect()]
    assert m["_m"] == pytest.approx(sum(want) / len(want))
    with pytest.raises(ValueError, match="unknown scoring"):
        EX._scored_metric(scored, "f7", "label", [])


def test_importance_by_task(rows):
    auc = EX.permutation_importance(rows, ["a", "b", "c"], EX.expr_scorer(lambda: F.col("a") + F.col("b")), repeats=3)
    got = {r["feature"]: r["attribution"] for r in auc.collect()}
    assert got["a"] > got["b"] > 0 and got["c"] == 0
    r2 = EX.permutation_importance(rows, ["a", "b", "c"], EX.expr_scorer(lambda: F.col("a") * 2 + F.col("b")), label="y", task="regression", repeats=3)
    got = {r["feature"]: r["attribution"] for r in r2.collect()}
    assert got["a"] > 1 and got["b"] > 0 and abs(got["c"]) < 1e-9
    (one,) = EX.permutation_importance(rows, ["a"], EX.expr_scorer(lambda: F.col("a"))).collect()
    assert tuple(one) == ("a", 1.0, 0.0)
