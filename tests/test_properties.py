"""Property and hand-computed tests of the operators (the reference's own tests
only check shapes; these check values)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- H1 / H2

def test_row_number_by_hash_equals_global_window(spark):
    from lucerna.functions.hashing import seeded_hash
    from lucerna.functions.ranking import row_number_by_hash
    df = spark.range(3000).withColumn("g", (F.col("id") % 3).cast("int"))
    got = row_number_by_hash(df, "id", 7, "rn", partition_cols=["g"], n_hex=2)
    w = Window.partitionBy("g").orderBy(seeded_hash("id", 7), "id")
    want = df.withColumn("rn2", F.row_number().over(w))
    j = got.join(want, ["id", "g"])
    assert j.where("rn != rn2").count() == 0
    assert j.count() == 3000


def test_exact_quantiles_match_numpy(spark):
    from lucerna.functions.ranking import exact_quantiles
    rng = random.Random(1)
    vals = [float(rng.randint(0, 50)) for _ in range(997)] + [7.0] * 400   # heavy ties
    df = _df(spark, [("a", v) for v in vals], "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", ["g"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_running_sums_match_cumsum(spark):
    from lucerna.functions.ranking import running_sums, with_value_bucket
    vals = list(range(1, 501))
    df = _df(spark, [(float(v), v % 7) for v in vals], "v double, w long")
    out = running_sums(with_value_bucket(df, "v", 16), ["v"], {"cum": F.col("w")}).orderBy("v").collect()
    assert [r["cum"] for r in out] == list(np.cumsum([v % 7 for v in vals]))


def test_t_test_p_value():
    from lucerna.functions.special import t_two_sided_p
    # r = 0.5 over 30 pairs: t = 3.055 on 28 dof; p = 0.0048999 (numerical integration)
    assert t_two_sided_p(0.5, 30) == pytest.approx(0.0048999, abs=2e-7)
    assert t_two_sided_p(0.0, 30) == pytest.approx(1.0)


# ---------------------------------------------------------------- split, balance, folds

def test_split_sizes_exact(spark):
    from lucerna.operators.sample import train_test_split
    df = spark.range(1001)
    s = train_test_split(df, "id", 0.8)
    assert s.where("split = 'train'").count() == 800
    assert s.where("split = 'test'").count() == 201
    with pytest.raises(ValueError):
        train_test_split(df, "id", 0.95)


def test_over_and_under_sample_balance(spark):
    from lucerna.operators.sample import random_over_sample, random_under_sample
    rows = [(i, 1 if i < 95 else 0, float(i)) for i in range(100)]   # 95 / 5
    df = _df(spark, rows, "id long, label int, x double")
    ros = random_over_sample(df)
    counts = {r[0]: r[1] for r in ros.groupBy("label").count().collect()}
    assert counts == {0: 95, 1: 95}
    syn = ros.where("synthetic")
    assert syn.agg(F.max("id")).first()[0] < 0 and syn.select("id").distinct().count() == 90
    rus = random_under_sample(df)
    assert {r[0]: r[1] for r in rus.groupBy("label").count().collect()} == {0: 5, 1: 5}


def test_class_weights(spark):
    from lucerna.operators.sample import class_weights
    df = _df(spark, [(i, 1 if i < 3 else 0) for i in range(4)], "id long, label int")
    w = {r["label"]: r["weight"] for r in class_weights(df).collect()}
    assert w[1] == pytest.approx(4 / (2 * 3)) and w[0] == pytest.approx(4 / (2 * 1))


def test_fold_sizes(spark):
    from lucerna.operators.folds import group_fold_map, kfold, stratified_kfold
    df = spark.range(23)
    sizes = sorted(r[1] for r in kfold(df).groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    lab = df.withColumn("label", (F.col("id") % 2).cast("int"))
    st = stratified_kfold(lab).groupBy("fold", "label").count().collect()
    assert max(r["count"] for r in st) - min(r["count"] for r in st) <= 1
    # floor(linspace(0, 5, n)) grouping: same sizes as numpy
    for n in (7, 71, 100):
        g = np.floor(np.linspace(0, 5, n)).astype(int)
        fmap = group_fold_map(n)
        assert set(fmap) == set(g.tolist())


# ---------------------------------------------------------------- scaling

def test_scalers(spark):
    from lucerna.operators.scale import normalise
    rows = [(i, float(i), float(i * i), 3.0) for i in range(1, 21)]
    df = _df(spark, rows, "id long, a double, b double, c double")
    mm = normalise(df, ["a", "b", "c"], "MM", "id").agg(F.min("a"), F.max("a"), F.max("c")).first()
    assert mm[0] == pytest.approx(0.0) and mm[1] == pytest.approx(1.0) and mm[2] == pytest.approx(0.0)
    sc = normalise(df, ["a"], "SC", "id").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert sc[0] == pytest.approx(0.0, abs=1e-12) and sc[1] == pytest.approx(1.0)
    smm = normalise(df, ["a", "b"], "SMM", "id").agg(F.min("b"), F.max("b")).first()
    assert smm[0] == pytest.approx(0.0, abs=1e-12) and smm[1] == pytest.approx(1.0)
    ne = normalise(_df(spark, [(1, 3.0, 4.0), (2, 0.0, 0.0)], "id long, a double, b double"), ["a", "b"], "NE", "id")
    got = {r["id"]: (r["a"], r["b"]) for r in ne.collect()}
    assert got[1] == pytest.approx((0.6, 0.8)) and got[2] == (0.0, 0.0)


def test_box_cox_lambda_of_lognormal(spark):
    from lucerna.operators.scale import power_transform
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=3000))
    df = _df(spark, [(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    _, lam = power_transform(df, ["x"], "BC")
    assert abs(lam["x"]) < 0.1
    with pytest.raises(ValueError):
        power_transform(_df(spark, [(1, -1.0)], "id long, x double"), ["x"], "BC")


def test_quantile_uniform_ties(spark):
    from lucerna.operators.scale import quantile_uniform
    df = _df(spark, [(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 4.0])], "id long, x double")
    got = {r["id"]: r["x"] for r in quantile_uniform(df, ["x"], "id").collect()}
    assert got == {0: 0.0, 1: pytest.approx(0.375), 2: pytest.approx(0.375), 3: 0.75, 4: 1.0}


# ---------------------------------------------------------------- metrics

def test_binary_metrics_hand_case(spark):
    from lucerna.operators.metrics import classification_metrics
    rows = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (0, 0)]
    df = _df(spark, rows, "label int, prediction int")
    m = {r["metric"]: r["value"] for r in classification_metrics(df).collect()}
    assert m["Accuracy"] == pytest.approx(66.667)
    assert m["Precision"] == pytest.approx(66.667)
    assert m["Recall"] == pytest.approx(66.667)
    assert m["Specificity"] == pytest.approx(66.667)
    assert m["Auc"] == pytest.approx(0.667)
    assert m["MCC"] == pytest.approx(0.333)


def test_regression_metrics_zero_target(spark):
    from lucerna.operators.metrics import regression_metrics
    df = _df(spark, [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    m = {r["metric"]: r["value"] for r in regression_metrics(df).collect()}
    assert m["Mean Absolute Error"] == pytest.approx(0.667)
    assert m["Coefficient of Determination"] == pytest.approx(0.75)
    assert m["Mean Absolute Percentage Error"] > 1e10   # zero target: divided by machine epsilon


def test_auc_with_ties(spark):
    from lucerna.operators.metrics import auc_ovr
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = _df(spark, rows, "label int, score double")
    assert auc_ovr(df).first()["auc"] == pytest.approx(0.875)


# ---------------------------------------------------------------- explanations

def _lin_df(spark, n=200):
    rng = random.Random(5)
    return _df(spark, [(i, rng.uniform(0, 10), rng.uniform(-5, 5)) for i in range(n)], "id long, a double, b double")


def test_linear_shapley_efficiency(spark):
    from lucerna.operators.explain import linear_shapley
    df = _lin_df(spark)
    coefs = {"a": 2.0, "b": -1.5}
    loc = linear_shapley(df, coefs, df)
    s = loc.groupBy("id").agg(F.sum("attribution").alias("s"))
    f = df.select("id", (2.0 * F.col("a") - 1.5 * F.col("b")).alias("f"))
    mean_f = f.agg(F.avg("f")).first()[0]
    bad = s.join(f, "id").where(F.abs(F.col("s") - (F.col("f") - mean_f)) > 1e-9).count()
    assert bad == 0


def test_integrated_gradients_completeness(spark):
    from lucerna.operators.explain import integrated_gradients_logistic
    df = _lin_df(spark, 50)
    coefs, c0 = {"a": 0.3, "b": -0.4}, -1.0
    base = {"a": 5.0, "b": 0.0}
    ig = integrated_gradients_logistic(df, coefs, c0, base, steps=400)
    s = {r["id"]: r["s"] for r in ig.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    fb = sig(c0 + 0.3 * 5.0)
    for r in df.collect():
        fx = sig(c0 + 0.3 * r["a"] - 0.4 * r["b"])
        assert s[r["id"]] == pytest.approx(fx - fb, abs=1e-4)


def test_pdp_of_linear_model_is_a_line(spark):
    from lucerna.operators.explain import expr_scorer, partial_dependence
    df = _lin_df(spark)
    sc = expr_scorer(lambda: 3.0 * F.col("a") + F.col("b"))
    pts = sorted((r[0], r[1]) for r in partial_dependence(df, "a", sc, [0.0, 1.0, 2.0, 5.0]).collect())
    slopes = {(y2 - y1) / (x2 - x1) for (x1, y1), (x2, y2) in zip(pts, pts[1:])}
    assert all(s == pytest.approx(3.0) for s in slopes)


def test_anchor_precision_threshold(spark):
    from lucerna.operators.explain import anchors
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(400)]
    df = _df(spark, rows, "id long, a double, b double").withColumn(
        "prediction", F.when(F.col("a") > 0.5, 1).otherwise(0))
    out = anchors(df, df.limit(50), ["a", "b"]).collect()
    best_prec = max(r["precision"] for r in out)
    assert best_prec >= 0.95
    for r in out:
        assert r["precision"] >= 0.95 or r["size"] >= 1


def test_permutation_importance_ranks_signal(spark):
    from lucerna.operators.explain import expr_scorer, permutation_importance
    rng = random.Random(9)
    rows = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(300)]
    df = _df(spark, rows, "id long, a double, b double").withColumn(
        "label", F.when(F.col("a") > 0, 1.0).otherwise(0.0))
    sc = expr_scorer(lambda: F.when(F.col("a") > 0, 1.0).otherwise(0.0))
    imp = {r["feature"]: r["attribution"] for r in permutation_importance(df, ["a", "b"], sc, repeats=3).collect()}
    assert imp["a"] > 0.3 and abs(imp["b"]) < 1e-9


def test_shorten_top10(spark):
    from lucerna.operators.explain import shorten_global
    df = _df(spark, [(f"f{i:02d}", float(i)) for i in range(15)], "feature string, attribution double")
    out = {r["feature"]: r["attribution"] for r in shorten_global(df).collect()}
    assert len(out) == 11 and out["Sum other 5 features"] == pytest.approx(0 + 1 + 2 + 3 + 4)


# ---------------------------------------------------------------- neighbours

def test_knn_exact_against_brute_force(spark):
    from lucerna.operators.neighbours import knn
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(300, 3)), np.zeros((40, 3)), rng.normal(8, 0.1, size=(5, 3))])
    df = _df(spark, [(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    got = knn(df, df, ["x", "y", "z"], 4, exclude_self=True)
    got = {(r["qid"], r["rank"]): r["nid"] for r in got.collect()}
    for q in (0, 17, 305, 344):
        d = np.sqrt(((pts - pts[q]) ** 2).sum(axis=1))
        order = sorted((d[i], i) for i in range(len(pts)) if i != q)[:4]
        assert [got[(q, k + 1)] for k in range(4)] == [i for _, i in order]


def test_smote_points_between_same_class_rows(spark):
    from lucerna.operators.neighbours import smote
    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 1), rng.uniform(0, 1), 1) for i in range(60)]
    rows += [(100 + i, rng.uniform(5, 6), rng.uniform(5, 6), 0) for i in range(8)]
    df = _df(spark, rows, "id long, a double, b double, label int")
    out = smote(df, ["a", "b"])
    syn = out.where("synthetic").collect()
    assert len(syn) == 52
    assert all(r["label"] == 0 and 5 <= r["a"] <= 6 and 5 <= r["b"] <= 6 for r in syn)


# ---------------------------------------------------------------- voting, consensus, rules

def test_vote_weights_sum_to_one(spark):
    from lucerna.operators.voting import model_weights
    rows = [("m1", "F1", 80.0), ("m2", "F1", 90.0), ("m3", "MCC", 0.1)]
    w = model_weights(_df(spark, rows, "model string, metric string, value double")).collect()
    assert sum(r["weight"] for r in w) == pytest.approx(1.0)
    assert {r["model"]: r["rank"] for r in w} == {"m2": 1, "m1": 2, "m3": 3}


def test_rule_parse_and_merge(spark):
    from lucerna.operators.rules import merge_ranges, parse_rules, rule_intervals
    txt = _df(spark, [("s", "[0=1.0-3.0^1=>2.5] V [0=2.0-5.0] V [0=<0.5]")], "source string, text string")
    preds = parse_rules(txt, ["a", "b"])
    got = sorted((r["rule_no"], r["feature"], r["op"], r["value"]) for r in preds.collect())
    assert got == [(0, "a", "<=", 3.0), (0, "a", ">=", 1.0), (0, "b", ">=", 2.5),
                   (1, "a", "<=", 5.0), (1, "a", ">=", 2.0), (2, "a", "<=", 0.5)]
    merged = {(r["feature"], r["lo"], r["hi"]) for r in merge_ranges(rule_intervals(preds)).collect()}
    assert merged == {("a", None, 0.5), ("a", 1.0, 5.0), ("b", 2.5, None)}


def test_consensus_harmonic_zero(spark):
    from lucerna.operators.consensus import harmonic_mean
    rows = [("m", "x", None, "f1", 0.0, None), ("m", "x", None, "f2", 1.0, None), ("m", "y", None, "f2", 0.5, None)]
    df = _df(spark, rows, "model string, method string, sample_id long, feature string, attribution double, probability double")
    got = {r["feature"]: r["attribution"] for r in harmonic_mean(df).collect()}
    assert got["f1"] == 0.0 and got["f2"] == pytest.approx(2 / (1 + 2))


# ---------------------------------------------------------------- sources and sinks

def test_read_table_csv_and_bad_extension(spark, tmp_dir):
    import os
    from lucerna.sources.tables import Roles, read_table
    p = os.path.join(tmp_dir, "t.csv")
    with open(p, "w") as f:
        f.write("id,height cm,age,target\n1,170,30,0\n2,,40,1\n")
    df = read_table(spark, p)
    r = Roles.positional(df)
    assert r.id_col == "id" and r.target_col == "target" and r.feature_cols == ["height cm", "age"]
    assert Roles.positional(df, predicting=True).feature_cols == ["height cm", "age", "target"]
    with pytest.raises(ValueError):
        read_table(spark, os.path.join(tmp_dir, "t.xlsx"))


def test_metrics_json_and_resume_roundtrip(spark, tmp_dir):
    import os
    from lucerna.operators.results import metrics_from_resume, read_metrics_json, write_metrics_json
    m = _df(spark, [("LR_1", "LR", "F1", 80.5)], "run string, model string, metric string, value double")
    write_metrics_json(m, os.path.join(tmp_dir, "m"))
    assert read_metrics_json(spark, os.path.join(tmp_dir, "m")).collect()[0]["value"] == 80.5
    with open(os.path.join(tmp_dir, "RF_resume.txt"), "w") as f:
        f.write("Config Data\n  seed: 3\nAnalysis Data\n  Accuracy:  91.2\n  F1:  88.0\n  MCC:  -0.1\n")
    got = {r["metric"]: r["value"] for r in metrics_from_resume(spark, os.path.join(tmp_dir, "*_resume.txt")).collect()}
    assert got == {"Accuracy": 91.2, "F1": 88.0, "MCC": -0.1}


def test_model_save_load_and_streaming_scoring(spark, tmp_dir):
    import os
    from lucerna.operators.models import fit_model, load_model, predict, save_model
    from lucerna.streaming.scoring import score_stream
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(200)]
    df = _df(spark, rows, "id long, a double, b double").withColumn(
        "label", F.when(F.col("a") > 0.5, 1).otherwise(0))
    m = fit_model(df, "DT", "classification", ["a", "b"])
    path = os.path.join(tmp_dir, "model")
    save_model(m, path)
    m2 = load_model(path)
    p1 = predict(m, df).orderBy("id").collect()
    p2 = predict(m2, df).orderBy("id").collect()
    assert [r["prediction"] for r in p1] == [r["prediction"] for r in p2]
    src = os.path.join(tmp_dir, "in")
    df.drop("label").write.parquet(src)
    out = score_stream(spark, m2, src, df.drop("label").schema, os.path.join(tmp_dir, "out"),
                       os.path.join(tmp_dir, "chk"), task="classification", once=True)
    assert out.count() == 200


def test_archive_attribution_and_state_io(spark, tmp_dir):
    import io
    import json
    import os
    import tarfile
    from lucerna.operators.models import fit_model
    from lucerna.sources.files import (load_state, read_archive_metrics, read_attribution_files, save_state,
                                       write_sorted_attributions)
    arch = os.path.join(tmp_dir, "runs")
    os.makedirs(arch)
    payload = json.dumps({"Analysis": {"Accuracy": 90.5, "Confusion matrix": [[1, 2], [3, 4]], "MCC": 0.4}}).encode()
    with tarfile.open(os.path.join(arch, "exp1_2024.tar.gz"), "w:gz") as t:
        info = tarfile.TarInfo("out/RF_data.json")
        info.size = len(payload)
        t.addfile(info, io.BytesIO(payload))
    got = {(r["key"], r["model"], r["metric"]): r["value"] for r in read_archive_metrics(spark, arch).collect()}
    assert got == {("exp1", "RF", "Accuracy"): 90.5, ("exp1", "RF", "MCC"): 0.4}
    adir = os.path.join(tmp_dir, "attr")
    os.makedirs(adir)
    with open(os.path.join(adir, "LR_Shapley_17.csv"), "w") as f:
        f.write("feature,attribution\na,0.5\nb,-1.0\n")
    with open(os.path.join(adir, "LR_PermutationImportance.csv"), "w") as f:
        f.write("feature,attribution\na,0.2\n")
    rows = read_attribution_files(spark, os.path.join(adir, "*.csv")).collect()
    assert {(r["model"], r["method"], r["sample_id"], r["feature"]) for r in rows} == {
        ("LR", "Shapley", "17", "a"), ("LR", "Shapley", "17", "b"), ("LR", "PermutationImportance", None, "a")}
    srt = os.path.join(tmp_dir, "sorted")
    write_sorted_attributions(spark.createDataFrame(rows).select("feature", "attribution"), srt)
    back = spark.read.option("header", "true").csv(srt).collect()
    assert [float(r["attribution"]) for r in back][0] == -1.0
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(50)], "id long, x double, label int")
    m = fit_model(df, "LR", "classification", ["x"])
    save_state(os.path.join(tmp_dir, "state"), df.withColumn("split", F.lit("train")), m)
    s2, m2 = load_state(spark, os.path.join(tmp_dir, "state"))
    assert s2.count() == 50 and len(m2.stages) == len(m.stages)


def test_mlp_regressor_learns(spark):
    from lucerna.operators.mlp import fit_mlp_regressor, mlp_predict
    rng = random.Random(4)
    rows = [(i, x, abs(x) * 3.0 + rng.gauss(0, 0.1)) for i, x in ((i, rng.uniform(-2, 2)) for i in range(400))]
    df = _df(spark, rows, "id long, x double, label double")
    m = fit_mlp_regressor(df, ["x"], hidden=8, epochs=150, lr=0.05)
    assert m["history"][-1] < 0.5 * m["history"][0]
    p = mlp_predict(m, df).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    var = np.var([r[2] for r in rows])
    assert p < 0.3 * var


def test_rulefit_and_ripper_rules(spark):
    from lucerna.operators.ripper import fit_ripper, predict_ripper
    from lucerna.operators.rulefit import fit_rulefit
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(600)]
    df = _df(spark, rows, "id long, a double, b double").withColumn(
        "label", F.when((F.col("a") > 0.6) & (F.col("b") < 0.5), 1).otherwise(0))
    rp = fit_ripper(df, ["a", "b"])
    assert rp["positive"] == 1 and rp["rules"]
    acc = predict_ripper(rp, df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9
    model, table = fit_rulefit(df, ["a", "b"], n_trees=5, max_depth=2)
    assert table.where("type = 'rule'").count() > 0
    assert model.transform(df).count() == 600
