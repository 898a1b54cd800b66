"""ML11: an ensemble from a folder of saved pipelines votes like the models it was made from."""

import random

import pytest

from lucerna.operators import models as ML
from lucerna.operators import voting as VO

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(i, x := rng.random(), y := rng.random(), int(x + y > 1)) for i in range(200)],
                                 "id long, a double, b double, label int").repartition(2).persist()


def test_saved_models_vote_like_fresh_ones(spark, rows, tmp_dir):
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    models = {n: ML.fit_model(train, n, "classification", COLS) for n in ("DT", "LR")}
    VO.save_models({"DT_first": models["DT"], "LR": models["LR"]}, tmp_dir)
    spark.range(3).write.parquet(f"{tmp_dir}/table")  # no model
    loaded = VO.load_models(spark, tmp_dir)
    assert sorted(loaded) == ["DT", "LR"]
    key = lambda df: sorted(map(tuple, df.collect()))
    fresh, saved = VO.vote(models, test), VO.vote(loaded, test)
    assert key(saved["vote"]) == key(fresh["vote"]) and key(saved["weights"]) == key(fresh["weights"])
    assert key(VO.fit_voting(train, test, ["DT", "LR"], COLS)["vote"]) == key(fresh["vote"])
    assert sorted(VO.load_models(spark, tmp_dir, ["LR", "RF"])) == ["LR"]


def test_empty_folders_doubles_and_missing_features_are_refused(spark, rows, tmp_dir):
    with pytest.raises(ValueError, match="no saved models"):
        VO.load_models(spark, f"{tmp_dir}/nothing")
    model = ML.fit_model(rows, "LR", "classification", COLS)
    VO.save_models({"LR_a": model, "LR_b": model}, tmp_dir)
    with pytest.raises(ValueError, match="two saved models"):
        VO.load_models(spark, tmp_dir)
    with pytest.raises(ValueError, match="does not have: b"):
        VO.vote({"LR": model}, rows.drop("b"))
    with pytest.raises(ValueError, match="at least one"):
        VO.vote({}, rows)
    svm = ML.fit_model(rows, "SVM", "classification", COLS, params={"n_components": 3, "maxIter": 2})
    assert sorted(set(VO.input_features(svm))) == COLS
