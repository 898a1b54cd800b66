"""EX3: entropy cuts against a plain tree, local fits against a direct weighted ridge, selection against enumeration."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.functions.local_fit import forward_selection
from lucerna.operators import explain as EX
from lucerna.operators.discretise import entropy_cuts, quartile_cuts, range_texts


def _entropy(y):
    return -sum(p * math.log2(p) for c in set(y) if (p := y.count(c) / len(y)))


def _plain_cuts(x, y, depth):
    pairs = sorted(zip(x, y))
    v = sorted(set(x))
    best = None
    for a, b in zip(v, v[1:]):
        left, right = [c for t, c in pairs if t <= a], [c for t, c in pairs if t > a]
        gain = round(_entropy(y) - (len(left) * _entropy(left) + len(right) * _entropy(right)) / len(y), 9)
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, a, b)
    if not depth or best is None:
        return []
    cut = (best[1] + best[2]) / 2
    sides = [[(t, c) for t, c in pairs if (t <= cut) == side] for side in (True, False)]
    return sorted([cut, *(c for s in sides for c in _plain_cuts([t for t, _ in s], [c for _, c in s], depth - 1))])


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(300):
        a, b, c = (round(rng.uniform(0, 10), 1) for _ in range(3))
        out.append((i, a, b, c, 7.0, (0 if a < 3 else 2 if a > 8 and b > 5 else 1)))
    return spark.createDataFrame(out, "id long, a double, b double, c double, k double, label int").repartition(3).persist()


def test_entropy_cuts_equal_a_plain_tree(rows):
    got = entropy_cuts(rows, ["a", "b", "c", "k"])
    data = rows.collect()
    for c in "abc":
        assert got[c] == pytest.approx(_plain_cuts([r[c] for r in data], [r["label"] for r in data], 3))
    assert got["k"] == [7.0] and any(abs(x - 3) < 0.2 for x in got["a"]) and len(got["a"]) <= 7
    assert range_texts("a", [1.0, 2.0]) == ["a <= 1.00", "1.00 < a <= 2.00", "a > 2.00"]


def test_local_fits_equal_a_direct_ridge(spark, rows):
    """Every row's weights by an explicit weighted ridge over the same samples."""
    cols = ["a", "b", "c"]
    scorer = EX.expr_scorer(lambda: 1 / (1 + F.exp(-(F.col("a") - 0.5 * F.col("b")))))
    seen = {}

    def spy(df):
        out = scorer(df)
        seen.setdefault("points", out)
        return out
    test = rows.where("id < 20")
    got = EX.lime_local(test, rows, cols, spy, n_samples=200, alpha=1.0).collect()
    cuts = quartile_cuts(rows, cols)
    points = seen["points"].toPandas()
    assert len(points) == 199
    own = {r["id"]: r for r in scorer(test.select("id", *cols)).collect()}
    for i, r in own.items():
        bins = np.array([np.searchsorted(cuts[c], r[c], "left") for c in cols])
        z = np.vstack([np.ones(3), points[[f"d_{c}" for c in cols]].to_numpy() == bins]).astype(float)
        y = np.append(r["score"], points["score"])
        w = np.sqrt(np.exp(-((1 - z) ** 2).sum(1) / (0.75 ** 2 * 3)))
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(3), (zc * w[:, None]).T @ yc)
        mine = {g["feature"]: g["attribution"] for g in got if g["id"] == i}
        assert [mine[c] for c in cols] == pytest.approx(coef.tolist(), abs=1e-9)


def test_the_explained_class_is_the_row_s_and_few_features_are_kept(rows):
    share = lambda c: EX.expr_scorer(lambda: c)
    low, high = F.when(F.col("a") < 3, 0.9).otherwise(0.05), F.when(F.col("a") < 3, 0.05).otherwise(0.6)
    got = EX.lime_local(rows, rows, ["a", "b", "c"], {0: share(low), 1: share(high), 2: share(F.lit(0.3))}, label="label",
                        num_features=1, n_samples=500).collect()
    by = {r["id"]: r for r in got}
    for r in rows.collect():
        assert by[r["id"]]["class"] == (0 if r["a"] < 3 else 1) and by[r["id"]]["feature"] == "a"
    assert len(got) == 300 and "a" in by[0]["range"]


def test_forward_selection_equals_enumeration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(80, 5))
    y = z @ [0.1, 3, 0, -2, 0.5] + rng.normal(size=80) * 0.1
    A, b = z.T @ z, z.T @ y
    loss = lambda s: ((y - z[:, s] @ np.linalg.solve(A[np.ix_(s, s)] + np.eye(len(s)), b[s])) ** 2).sum()
    for k in (1, 2, 3):
        best = min(itertools.combinations(range(5), k), key=lambda s: loss(list(s)))
        assert sorted(forward_selection(A, b, y @ y, k, 1.0)) == list(best)
