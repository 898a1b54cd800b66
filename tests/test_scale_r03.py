"""Findings of the round: what each query must not do again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.functions.hashing import hash_uniform, seeded_hash
from lucerna.operators import consensus as CO
from lucerna.operators import explain as EX
from lucerna.operators import search as HS
from lucerna.operators import treeshap as TS


@pytest.fixture()
def attr(spark):
    rows = [(m, k, i, f, (i * 7 + j * 3) % 11 / 5 - 1, 0.5) for m in ("A", "B") for k in ("x", "y") for i in range(4) for j, f in enumerate("pqr")]
    return spark.createDataFrame(rows, "model string, method string, sample_id long, feature string, attribution double, probability double")


def test_model_extremes_are_broadcast(spark, attr):
    """A join by model filled one task per model."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for f in (CO.harmonic_mean, CO.geometric_mean):
            plan = f(attr)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(name, was)


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 1.0])
def test_changes_by_hex_text_are_those_of_the_number(spark, p):
    """Counterfactuals compare the hash as text (F1, F2): the same rows change."""
    limit = math.ceil(p * 2 ** 32)
    text = seeded_hash("id", 0, "f") < F.lit(f"{limit:08x}" if limit < 2 ** 32 else "g")
    assert spark.range(5000).where(text != (hash_uniform("id", 0, "f") < p)).count() == 0


def test_counterfactuals_parse_no_number_to_decide(spark):
    from lucerna.operators import explain as EX
    df = spark.range(20).selectExpr("id", "CAST(id AS DOUBLE) AS a")
    out = EX.counterfactuals(df, df, ["a"], EX.expr_scorer(lambda: F.col("a") / 20), lambda s, o: (s >= 0.5) != (o >= 0.5), n_candidates=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "0.3" not in plan and "4ccccccd" in plan


def test_op1_model_has_one_order_whatever_the_size(spark):
    """The order switched at a number of n-grams."""
    from lucerna.llm import perplexity
    small = spark.createDataFrame([("a few words here",)], "text string")
    assert perplexity.train(small).order == perplexity.MODEL_ORDER
    assert perplexity.LIMIT == perplexity.CLASSES ** perplexity.MODEL_ORDER


def test_shapley_weights_are_tabled():
    """Factorials were worked out in Python for every leaf and mask (F8)."""
    plus, minus = TS._weights(6)
    for a in range(7):
        for b in range(7):
            assert plus[a, b] == (math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b) if a else 0.0)
            assert minus[a, b] == (math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b) if b else 0.0)
    assert np.isfinite(plus).all()


def test_folds_are_ranked_once(spark, monkeypatch):
    """Each fit and score ranked the folds anew (F7, F23): the operators fit on persisted rows."""
    df = spark.range(60).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 7 > 3 AS INT) AS label", "CAST(id % 3 AS INT) AS fold")
    seen = []
    real = HS.fit_model

    def fit(train, *args, **kw):
        seen.append("InMemory" in train._jdf.queryExecution().withCachedData().toString())
        return real(train, *args, **kw)
    monkeypatch.setattr(HS, "fit_model", fit)
    HS.run_folds(df, "LR", "classification", ["a"]).collect()
    assert len(seen) == 3 and all(seen)
    spark.catalog.clearCache()
    seen.clear()
    out = HS.successive_halving_mlp(df, ["a"], 2, n_candidates=3, budgets=(1, 2)).collect()
    assert len(out) == 4 and all(seen) and [r["round"] for r in out] == [0, 0, 0, 1]


def test_files_of_placed_samples_are_not_shuffled(spark, attr):
    """Every attribution row was shuffled to its file and again to its model."""
    from lucerna.plans.fixtures import FEATURES, Views
    v = Views(spark, "/root/testdata/sf0.001")
    quality = spark.createDataFrame([("LR", 0.8), ("RF", 0.9)], "model string, metric double")
    ranked = CO.with_ranking(v.attributions).where("sample_id is not null")
    for df in (ranked, CO.scale_max_abs(v.attributions).where("sample_id is not null"),
               CO.complete_features(CO.weighted_capped(ranked, quality), FEATURES), CO.ranks_by_sample(CO.with_ranking(v.attributions))):
        keys = [p.split("#")[0] for p in df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]]
        assert set(keys) <= {"l_orderkey", "id"}, keys  # the view's own


def _flat(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_words_are_learned_without_a_split_per_word(monkeypatch):
    """op10_token_index: numpy's split cost more than the library's own encoding of new words."""
    from lucerna.llm import wavelet as W
    from lucerna.llm.queries import TOKENIZERS
    encoder = W.WordEncoder(f"{TOKENIZERS}/word_bpe_49k.json")
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(200)] + ["7", "unbelievably", "...", "8"]

    def refuse(*_):
        raise AssertionError("one array per word")
    monkeypatch.setattr(W.np, "split", refuse)
    encoder._learn(list(range(len(words))), words)
    for i, ids in enumerate(encoder._ids(words)):
        at = encoder.at[encoder.slot[i]]
        assert encoder.flat[at:at + encoder.sizes[encoder.slot[i]]].tolist() == ids.tolist()


def test_repeats_are_scored_one_by_one(spark):
    """the copies of all repeats were shuffled at once, and filled the disk."""
    t = spark.range(300).select("id", *[(F.xxhash64("id", F.lit(c)) % 100 / 10.0).alias(c) for c in "abc"])
    t = t.withColumn("label", (F.col("a") + F.col("b") > 1).cast("int"))
    seen = []

    def score(df):
        seen.append(df.count())
        return df.withColumn("score", F.col("a") + F.col("b"))
    out = {r["feature"]: r for r in EX.permutation_importance(t, list("abc"), score, repeats=4).collect()}
    assert max(seen) == 900 and seen.count(900) >= 4
    assert out["a"]["attribution"] > 0.1 and out["c"]["attribution"] == 0 and out["a"]["std"] > 0


def test_auc_joins_no_rows(spark):
    """offsets were joined to every distinct score, and the scores read again for borders."""
    from lucerna.operators.metrics import auc_ovr
    t = spark.range(500).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 40 / 8.0).alias("score"),
                                F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")).alias("label"))
    out = auc_ovr(t, group_cols=["g"], splits=[-np.inf, -2.0, 0.0, 0.5, np.inf])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, data = {r["g"]: r["auc"] for r in out.collect()}, t.toPandas()
    for g, part in data.dropna().groupby("g"):
        # a null label counts as no positive and, beside labelled rows of its score, as a negative
        low = data[(data.g == g) & data.score.isin(part.score)]
        pos, neg = low[low.label == 1].score.to_numpy(), low[low.label != 1].score.to_numpy()
        want = ((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean()
        assert abs(got[g] - want) < 1e-12


def test_exact_quantiles_broadcast_what_belongs_to_a_group(spark):
    """distinct values were shuffled by feature to meet their group's borders."""
    from lucerna.functions.ranking import exact_quantiles
    t = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 2).alias("feature"), F.col("id").cast("double").alias("value"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = exact_quantiles(t, "value", ["feature"], [0.5])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {tuple(r) for r in out.collect()} == {("f0", 0.5, 99.0), ("f1", 0.5, 100.0)}
    finally:
        spark.conf.set(name, was)


def test_lime_rows_join_no_samples(spark):
    """attributions met ranges and predictions by joins of all (sample, feature) rows."""
    from lucerna.plans.fixtures import FEATURES, Views
    v = Views(spark, "/root/testdata/sf0.001")
    one = v.order_features.where("n_lines > 3")
    two = one.orderBy("id").limit(1).withColumn("sum_qty", F.lit(1.0))
    v._cache["order_features"] = (spark.createDataFrame(one.unionByName(two).toPandas(), one.schema)
                                  .withColumn("sum_tax", F.lit(None).cast("double")))
    rows = v.lime_rows
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    n, per = one.count(), rows.groupBy("sample_id").count()
    # five features with values and two models; two rows of one id meet in attribution, range and prediction
    counts = {r["sample_id"]: r["count"] for r in per.collect()}
    assert len(counts) == n and sorted(counts.values()) == [10] * (n - 1) + [80]
    twice = rows.where(F.col("sample_id") == two.first()["id"])
    assert twice.select("class").distinct().count() == 2 and twice.where("range like '%sum_qty%'").select("range").distinct().count() == 2
    assert len(FEATURES) == 6
    spark.catalog.clearCache()


def _labelled(spark):
    t = spark.range(400).select("id", *[(F.xxhash64("id", F.lit(c)) % 50 / 10.0).alias(c) for c in "abc"])
    return t.withColumn("label", (F.col("a") * 2 + F.col("b") > 1).cast("int"))


def test_dependence_of_a_forest_counts_paths(spark):
    """every row was copied to a hundred grid points; the means are the same, nulls and NaN too."""
    from lucerna.operators.models import fit_model
    t = _labelled(spark)
    odd = t.withColumn("b", F.when(F.col("id") % 5 == 1, None).when(F.col("id") % 5 == 2, float("nan")).otherwise(F.col("b")))
    for name, task, use in (("RF", "classification", 1), ("DT", "classification", 0), ("RF", "regression", None), ("XGBOOST", "regression", None)):
        m = fit_model(t, name, task, list("abc"), params={} if name == "DT" else {"numTrees": 7} if name == "RF" else {"maxIter": 3})
        scorer = EX.pipeline_scorer(m, use)
        want = EX.partial_dependence(odd, "a", lambda df: scorer(df), [-9.0, -1.0, 0.1, 0.1, 2.0, 9.0])
        got = EX.partial_dependence(odd, "a", scorer, [-9.0, -1.0, 0.1, 0.1, 2.0, 9.0])
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        got, want = _flat(got), _flat(want)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert EX.partial_dependence(odd.where("false"), "a", scorer, [1.0]).count() == 0


def test_gradients_of_a_perceptron_are_matrices(spark):
    """every row was copied to 612 points; attributions are the same, nulls and copies of an id too."""
    from lucerna.operators.models import fit_model
    t = _labelled(spark)
    m = fit_model(t, "ANN", "classification", list("abc"), params={"maxIter": 15})
    rows = t.limit(30).withColumn("b", F.when(F.col("id") != 3, F.col("b")))
    rows = rows.unionByName(rows.where("id < 5"))
    base = {"a": 0.3, "b": -0.2, "c": 0.0}
    scorer = EX.pipeline_scorer(m, 1)
    out = EX.integrated_gradients(rows, base, list("abc"), scorer)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got, want = _flat(out), _flat(EX.integrated_gradients(rows, base, list("abc"), lambda df: scorer(df)))
    assert set(got) == set(want) and len(got) == 90 and got[3, "b"] is None and want[3, "b"] is None
    assert all(a == b or abs(a - b) < 1e-8 or a != a and b != b for k in want for a, b in [(got[k] or 0.0, want[k] or 0.0)])
