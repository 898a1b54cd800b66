"""EX15: the level-wise search against enumeration of every conjunction."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.operators.explain import anchors

COLS = list("abcde")


def _brute(rows, threshold):
    """Best conjunction per row: (size, precision, coverage) by the documented order, over all subsets."""
    x = np.array([r[1:6] for r in rows])
    y = np.array([r[6] for r in rows])
    cuts = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    bins = np.stack([np.searchsorted(cuts[:, j], x[:, j], "left") for j in range(5)], 1)
    out = {}
    for i in range(len(rows)):
        found = []
        for size in range(1, 6):
            for s in itertools.combinations(range(5), size):
                inside = (bins[:, s] == bins[i, s]).all(1)
                precision, coverage = (y[inside] == y[i]).mean(), inside.mean()
                ok = precision >= threshold
                found.append((0 if ok else 1, size if ok else 0, -coverage if ok else -precision, size, -coverage, precision))
        best = min(found, key=lambda f: f[:5])
        tied = {round(f[5], 9) for f in found if f[:5] == best[:5]}  # the rule text decides between these
        out[rows[i][0]] = (best[3], round(-best[4], 9), tied)
    return out


@pytest.mark.parametrize("threshold", [0.95, 0.7])
def test_anchors_equal_enumeration(spark, threshold):
    """The class needs four of five features, so short conjunctions are not precise."""
    rng = random.Random(5)
    rows = []
    for i in range(250):
        v = [round(rng.random(), 3) for _ in COLS]
        rows.append((i, *v, int(sum(x > 0.5 for x in v[:4]) % 2)))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLS) + ", prediction int").repartition(3)
    got = {r["id"]: r for r in anchors(df, df, COLS, threshold=threshold).collect()}
    want = _brute(rows, threshold)
    assert set(got) == set(want)
    for i, (size, coverage, precisions) in want.items():
        assert (got[i]["size"], round(got[i]["coverage"], 9)) == (size, coverage) and round(got[i]["precision"], 9) in precisions
    assert threshold < 0.9 or max(r["size"] for r in got.values()) > 3
    out = anchors(df, df.where("id < 5"), COLS, threshold=threshold).collect()
    assert all(r["rule"].count(" AND ") == r["size"] - 1 for r in out) and len(out) == 5
    assert anchors(df, df.limit(0), COLS).count() == 0
