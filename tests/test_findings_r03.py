"""Findings of round 3: what a task holds, what is shuffled, the same results."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lucerna.operators import explain as EX
from lucerna.operators import neighbours as NB


def test_routed_rows_come_in_small_frames():
    """One query row is copied for every ring it meets."""
    rng = np.random.default_rng(3)
    rows = [{"g": "", "cell": c, "ring": r, "low": 0.1 * r, "high": 0.1 * r + 0.1, "n": 10} for c in range(10) for r in range(50)]
    rings = NB._Rings(rng.random((10, 3)), rows)
    queries = pd.DataFrame({"qid": range(1000), "g": "", "v": list(rng.random((1000, 3))), "theta": np.inf})
    frames = list(NB._route(rings, 5000, True)(iter([queries])))
    assert max(len(f) for f in frames) <= NB.ROUTED // 10
    met = pd.concat(frames)
    assert len(met) == 500 * 1000 and len(met.drop_duplicates(["qid", "cell", "ring"])) == len(met)
    assert all(np.array_equal(v, queries["v"][q]) for q, v in zip(met["qid"][:2000], met["v"][:2000]))


def test_shapley_points_fold_before_the_shuffle(spark):
    """no window over the points of whole rows; nulls and copies of an id as before."""
    t = spark.range(40).select("id", *[(F.xxhash64("id", F.lit(c)) % 100 / 10.0).alias(c) for c in "abc"])
    rows = t.withColumn("b", F.when(F.col("id") % 7 != 1, F.col("b")))
    rows = rows.unionByName(rows.where("id = 2"))
    score = EX.expr_scorer(lambda: F.col("a") * F.col("b") + F.col("c"))
    out = EX.sampled_shapley(rows, t, list("abc"), score, n_draws=8, n_background=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_s2" in plan and plan.count("Window [") == 1
    got = {(r["id"], r["feature"]): r["attribution"] for r in out.collect()}
    assert len(got) == 120 and all((got[i, "b"] is None) == (i % 7 == 1) for i in range(40))
    plain = {(r["id"], r["feature"]): r["attribution"] for r in
             EX.sampled_shapley(t.where("id = 2"), t, list("abc"), score, n_draws=8, n_background=10).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in plain.items())


def test_boosting_rows_are_blocks_and_trees_are_walked_by_look_up(spark):
    """A level reads some thousand rows as one; positions as node by node."""
    from lucerna.operators import boosting as BO
    rng = np.random.default_rng(5)
    tree = BO.Tree(rng.integers(0, 3, 7).astype(np.int32), rng.integers(0, 8, 7).astype(np.int32), rng.random(7) < 0.5, rng.random(8))
    bins = rng.integers(0, 9, (200, 3)).astype(np.int16)
    for levels in range(4):
        want = []
        for row in bins:
            at = 0
            for _ in range(levels):
                b = row[tree.feature[at]]
                at = 2 * at + (1 if (tree.missing_left[at] if b == 8 else b <= tree.cut[at]) else 2)
            want.append(at)
        assert tree.place(bins, levels, 8).tolist() == want
    df = spark.createDataFrame([(i, float(i % 9) if i % 5 else None, i % 2 if i % 50 else None) for i in range(1000)], "id long, a double, label int").coalesce(2)
    use = BO.Boosting(max_bin=16)
    edges = BO._bin_edges(df, ["a"], 16)
    rows = BO._binned(df, ["a"], "label", None, edges, use, 1, 0.0).collect()
    assert len(rows) == 2
    y = np.concatenate([np.frombuffer(r["y"]) for r in rows])
    assert len(y) == 980 and all(len(r["bins"]) == 2 * len(r["y"]) // 8 for r in rows)
