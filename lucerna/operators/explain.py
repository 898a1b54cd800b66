"""EX1-EX22: explanation methods as "perturb -> score -> aggregate" jobs.

A model is any callable ``scorer(df) -> df`` that adds a numeric ``score``
column (a fitted PipelineModel wrapped by :func:`pipeline_scorer`, or a
fixed column expression wrapped by :func:`expr_scorer`).  Perturbations are
generated with ``explode`` over bounded sequences (steps, grid points,
candidates), keyed by the sample id, and scored in one ``transform``;
results come back through grouped aggregations.  Randomness is H1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd, with_scalars
from lucerna.functions.hashing import TWO_32, hash_uniform
from lucerna.functions.md5 import Keys
from lucerna.functions.ranking import exact_quantiles, row_number_by_hash, value_splits
from lucerna.operators.models import probability_array
from lucerna.session import checkpoint_dir, shuffles_dropped

Scorer = Callable[[DataFrame], DataFrame]

IG_STEPS = 50
PDP_GRID = 100
TOP_FEATURES = 10
BORDER_ROWS = 20_000  # rows whose scores place the borders of the score buckets (balance only, no result)


# ---------------------------------------------------------------- scorers

def expr_scorer(expr_fn: Callable[[], Column]) -> Scorer:
    """A model given as a column expression over the feature columns."""
    return lambda df: df.withColumn("score", expr_fn())


def pipeline_scorer(model, positive_class: int | None = 1) -> Scorer:
    """A fitted PipelineModel: class probability (or the regression prediction)."""
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if positive_class is not None and "probability" in out.columns:
            s = probability_array(out)[positive_class]
        else:
            s = F.col("prediction")
        keep = [c for c in df.columns]
        return out.select(*keep, s.cast("double").alias("score"))
    score.model, score.positive_class = model, positive_class  # explainers may read the model's form
    return score


def _fitted_stage(scorer: Scorer):
    """The fitted stage of a scorer and its columns in order, where rows go to it as they are; else None."""
    stages = getattr(getattr(scorer, "model", None), "stages", [])
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or stages[0].getHandleInvalid() != "keep":
        return None
    return stages[1], stages[0].getInputCols()


# ---------------------------------------------------------------- EX6/EX7 linear Shapley

def linear_shapley(df: DataFrame, coefs: dict[str, float], background: DataFrame,
                   id_col: str = "id") -> DataFrame:
    """EX6 for linear models: phi_i = w_i (x_i - mean_b x_i), long (id, feature, attribution, value).

    Exact Shapley values of f(x) = w.x + c against the background table; the
    background means are one aggregate row (broadcast).
    """
    feats = [f for f in coefs if not f.startswith("__")]
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in feats])
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             (F.lit(coefs[f]) * (F.col(f).cast("double") - F.col(f"m_{f}"))).alias("attribution"),
                             F.col(f).cast("double").alias("value")) for f in feats])
    return (with_scalars(df, means)  # one row of means, as literals
            .select(id_col, F.explode(arr).alias("s")).select(id_col, "s.*"))


def shapley_global(local: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EX7: sum of |local value| per feature."""
    return local.groupBy(*keys, "feature").agg(F.sum(F.abs("attribution")).alias("attribution"))


# ---------------------------------------------------------------- EX8/EX9 integrated gradients

def integrated_gradients_logistic(df: DataFrame, coefs: dict[str, float], intercept: float,
                                  baseline: dict[str, float], id_col: str = "id",
                                  steps: int = IG_STEPS) -> DataFrame:
    """EX8 for a logistic model p = sigmoid(w.x + c): exact gradient, trapezoid rule.

    attribution_i = (x_i - b_i) w_i sum_k c_k p_k (1 - p_k), p_k at
    b + (k / steps)(x - b), c_0 = c_steps = 0.5 / steps, else 1 / steps.
    The path sum is a per-row higher-order ``aggregate`` (no explode, no shuffle).
    """
    feats = list(coefs)
    z_b = sum(coefs[f] * baseline[f] for f in feats) + intercept
    z_x = F.lit(intercept)
    for f in feats:
        z_x = z_x + F.lit(coefs[f]) * F.col(f).cast("double")
    dz = z_x - F.lit(z_b)

    def step(acc, k):
        a = k.cast("double") / F.lit(float(steps))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(z_b) + a * dz)))
        ck = F.when((k == 0) | (k == steps), 0.5 / steps).otherwise(1.0 / steps)
        return acc + ck * p * (F.lit(1.0) - p)
    g = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), step)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             ((F.col(f).cast("double") - F.lit(baseline[f])) * F.lit(coefs[f]) * F.col("_g"))
                             .alias("attribution")) for f in feats])
    return (df.select(id_col, *feats).withColumn("_g", g)
            .select(id_col, F.explode(arr).alias("s")).select(id_col, "s.*"))


def integrated_gradients(rows: DataFrame, baseline: dict[str, float], feature_cols: Sequence[str],
                         scorer: Scorer, id_col: str = "id", steps: int = IG_STEPS,
                         rel_step: float = 1e-5) -> DataFrame:
    """EX8 for any model: the gradient on the path is a central difference.

    Feature f is moved by ``rel_step`` of its range in ``rows`` (1 if constant) to
    both sides of every path point; weights as in the closed form.  Rows x
    steps x features x 2 points are scored in one pass and fold into one row
    per (id, feature) before the shuffle.  A null feature gives null for its row.
    A perceptron's points are made and scored as matrices, a few hundred rows at a
    time, and a row leaves its task as one row.  Output: id, feature, attribution.
    """
    cols = list(feature_cols)
    x = {c: F.col(c).cast("double") for c in cols}
    ext = rows.agg(*[(F.max(x[c]) - F.min(x[c])).alias(c) for c in cols]).first().asDict()
    h = {c: rel_step * (ext[c] or 1.0) for c in cols}
    fitted = _fitted_stage(scorer)
    if fitted and isinstance(fitted[0], MultilayerPerceptronClassificationModel) and fitted[1] == cols and scorer.positive_class is not None:
        net = _Perceptron(fitted[0], scorer.positive_class)
        kind = rows.schema[id_col].dataType.simpleString()
        walk = _path_slopes(net, cols, [baseline[c] for c in cols], [h[c] for c in cols], steps)
        local = (rows.select(F.col(id_col).alias("id"), *[x[c].alias(f"x{i}") for i, c in enumerate(cols)])
                 .mapInArrow(walk, f"id {kind}, " + ", ".join(f"a{i} double" for i in range(len(cols)))))
        whole = local.groupBy("id").agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in range(len(cols))])
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("attribution")) for i, c in enumerate(cols)])
        return whole.select("id", F.explode(pairs).alias("s")).select("id", "s.*")
    pts = rows.select(F.col(id_col).alias("id"), *[x[c].alias(c) for c in cols])
    pts = (pts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
           .withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(cols))])))
           .withColumn("_side", F.explode(F.array(F.lit(-1.0), F.lit(1.0)))))
    a = F.col("_k") / F.lit(float(steps))
    share = F.when((F.col("_k") == 0) | (F.col("_k") == steps), 0.5 / steps).otherwise(1.0 / steps)
    slope = F.array(*[(F.col(c) - F.lit(baseline[c])) / F.lit(2.0 * h[c]) for c in cols])[F.col("_f")]
    moved = [(F.lit(baseline[c]) + a * (F.col(c) - F.lit(baseline[c]))
              + F.when(F.col("_f") == i, F.col("_side") * F.lit(h[c])).otherwise(0.0)).alias(c)
             for i, c in enumerate(cols)]
    scored = scorer(pts.select("id", "_f", (share * F.col("_side") * slope).alias("_w"), *moved))
    names = F.array(*[F.lit(c) for c in cols])
    return (scored.groupBy("id", "_f").agg(F.sum(F.col("_w") * F.col("score")).alias("attribution"))
            .select("id", names[F.col("_f")].alias("feature"), "attribution"))


class _Perceptron:
    """A fitted perceptron's probability of one class, for matrices of rows."""

    def __init__(self, model: MultilayerPerceptronClassificationModel, class_index: int):
        sizes, flat, at = model.getLayers(), model.weights.toArray(), 0
        self.class_index, self.layers = class_index, []
        for n, m in zip(sizes, sizes[1:]):  # per layer: its matrix by columns, then its offsets
            self.layers.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
            at += n * m + m

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            for w, b in self.layers[:-1]:
                x = 1.0 / (1.0 + np.exp(-(x @ w + b)))
        w, b = self.layers[-1]
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e[:, self.class_index] / e.sum(axis=1)


def _path_slopes(net: _Perceptron, cols: list[str], baseline: list[float], h: list[float], steps: int, rows: int = 256):
    """Per row, the path sum of every feature's difference quotients: 2 points a feature and step, ``rows`` rows at a time."""
    d, base, move = len(cols), np.array(baseline, float), np.array(h, float)
    sides = np.concatenate([np.diag(move), -np.diag(move)])[:, None, :]  # forward points, then backward

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(d)]).astype(float, copy=False)
            total = np.zeros_like(x)
            for at in range(0, len(x), rows):
                way = x[at:at + rows] - base
                for k in range(steps + 1):
                    share = (0.5 if k in (0, steps) else 1.0) / steps
                    points = base + k / steps * way + sides
                    p = net(points.reshape(-1, d)).reshape(2, d, len(way))
                    total[at:at + rows] += share * (p[0] - p[1]).T
                total[at:at + rows] *= way / (2.0 * move)
            none = [batch.column(f"x{i}").is_null().to_numpy(zero_copy_only=False) for i in range(d)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(total[:, i], pa.float64(), mask=none[i]) for i in range(d)]],
                ["id", *[f"a{i}" for i in range(d)]])
    return run


def global_mean_std(local: DataFrame, keys: Sequence[str] = (), pop: bool = True) -> DataFrame:
    """EX9 (population std) / EX4 (sample std): mean and std of local attributions."""
    sd = F.stddev_pop if pop else F.stddev_samp
    return local.groupBy(*keys, "feature").agg(F.avg("attribution").alias("attribution"),
                                               sd("attribution").alias("std"))


# ---------------------------------------------------------------- EX12/EX13 partial dependence

def pdp_grid(train: DataFrame, feature: str, n_points: int = PDP_GRID) -> list[float]:
    """EX12 grid: distinct values if fewer than n_points, else n_points equal steps
    between the 5th and 95th percentiles (exact)."""
    distinct = (train.select(F.col(feature).cast("double").alias("v")).distinct()
                .limit(n_points).collect())
    if len(distinct) < n_points:
        return sorted(r[0] for r in distinct if r[0] is not None)
    long = train.select(F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value"))
    qs = {r["p"]: r["q"] for r in exact_quantiles(long, "value", ["feature"], [0.05, 0.95]).collect()}
    lo, hi = qs[0.05], qs[0.95]
    return [lo + (hi - lo) * i / (n_points - 1) for i in range(n_points)]


def partial_dependence(train: DataFrame, feature: str, scorer: Scorer, grid: Sequence[float] | None = None,
                       id_col: str = "id", per_row: bool = False) -> DataFrame:
    """EX12 PDP (mean score per grid value) / EX13 ICE (``per_row``: one curve per row).

    Rows x grid points via ``explode`` of the bounded grid literal.  The mean of a model
    whose score adds up leaves (trees, forests) needs no copies: a leaf counts for the
    rows that meet its path's conditions on the other features, at the grid points
    that meet those on ``feature``, so one pass counts rows and the grid is looked up.
    """
    grid = list(grid) if grid is not None else pdp_grid(train, feature)
    fitted = None if per_row else _fitted_stage(scorer)
    if fitted and feature in fitted[1] and _adds_leaves(fitted[0], scorer.positive_class):
        return _leaf_dependence(train, feature, scorer, list(fitted[1]), [float(x) for x in grid])
    g = F.array(*[F.lit(float(x)) for x in grid])
    exploded = train.withColumn("grid_value", F.explode(g)).withColumn(feature, F.col("grid_value"))
    scored = scorer(exploded)
    if per_row:
        return scored.select(id_col, "grid_value", F.col("score").alias("prediction"))
    return scored.groupBy("grid_value").agg(F.avg("score").alias("mean_prediction"))


def _adds_leaves(stage, positive_class: int | None) -> bool:
    """True for a stage whose score is a sum of leaf values."""
    name = type(stage).__name__
    if positive_class is None or "Regression" in name:
        return name in ("DecisionTreeRegressionModel", "RandomForestRegressionModel", "GBTRegressionModel")
    return name in ("DecisionTreeClassificationModel", "RandomForestClassificationModel")


def _meets(x, above: float, up_to: float):
    """Where a tree's path is followed: a value that is no number takes every right turn."""
    inside = np.ones(np.shape(x), bool) if above == -math.inf else ~(x <= above)
    return inside if up_to == math.inf else inside & (x <= up_to)


def _count_paths(paths: list[tuple], cols: list[str]):
    """Rows that follow each path, in all rows of a task; path -1 counts the rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(paths), np.int64)
        rows = 0
        for f in frames:
            x = [f[c].to_numpy(float) for c in cols]
            met = {part: _meets(x[part[0]], *part[1:]) for part in {p for path in paths for p in path}}
            every = np.ones(len(f), bool)
            rows += len(f)
            for i, path in enumerate(paths):
                total[i] += np.count_nonzero(reduce(np.logical_and, [met[p] for p in path], every))
        yield pd.DataFrame({"path": np.arange(-1, len(paths)), "n": np.concatenate([[rows], total])})
    return run


def _leaf_dependence(train: DataFrame, feature: str, scorer: Scorer, cols: list[str], grid: list[float]) -> DataFrame:
    """:func:`partial_dependence` of a sum of leaves; only counts per path, bounded by the model, reach the driver."""
    from lucerna.operators.treeshap import leaves_of
    leaves, own = leaves_of(train, scorer.model, scorer.positive_class), cols.index(feature)
    others = [tuple(p for p in leaf.path if p[0] != own) for leaf in leaves]
    paths = list(dict.fromkeys(others))
    where = {path: i for i, path in enumerate(paths)}
    counted = (train.select(*[F.col(c).cast("double").alias(c) for c in cols])
               .mapInPandas(_count_paths(paths, cols), "path long, n long").groupBy("path").agg(F.sum("n")))
    n = dict(counted.collect())
    rows, points = n.get(-1, 0), list(dict.fromkeys(grid))
    at, sums = np.array(points, float), np.zeros(len(points))
    for leaf, path in zip(leaves, others, strict=True):
        met = [_meets(at, *p[1:]) for p in leaf.path if p[0] == own]
        sums += np.where(met[0] if met else True, leaf.value * n.get(where[path], 0), 0.0)
    return train.sparkSession.createDataFrame([(g, float(s) / rows) for g, s in zip(points, sums)] if rows else [],
                                              "grid_value double, mean_prediction double")


def ice_rows(train: DataFrame, id_col: str = "id", max_rows: int | None = None, seed=0) -> DataFrame:
    """EX13 rows: all of them, or the first ``max_rows`` in seeded hash order if the caller asks for a sample."""
    if max_rows is None:
        return train
    return row_number_by_hash(train, id_col, seed, "_rn").where(F.col("_rn") <= max_rows).drop("_rn")


# ---------------------------------------------------------------- EX14 ALE

def ale(train: DataFrame, feature: str, scorer: Scorer, n_bins: int = 10,
        id_col: str = "id", per_class: bool = False) -> DataFrame:
    """EX14: accumulated local effects over quantile bins, centred.

    Edges = distinct exact quantiles k / n_bins; a row with edge_{k-1} < x <= edge_k
    (the first bin closed) is scored at both edges; effect_k = mean difference;
    ALE_k = cumulative sum; centred by the row-weighted mean of bin midpoints
    ((ALE_{k-1} + ALE_k) / 2).  Output: bin, lower, upper, n, effect, ale.  With ``per_class``
    the scorer gives a ``probability`` array (:func:`probability_scorer`), every class has
    effects of its own from the same two scored copies, and the output starts with ``class``.
    """
    long = train.select(F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value"))
    edges = sorted({r["q"] for r in exact_quantiles(long, "value", ["feature"],
                                                    [i / n_bins for i in range(n_bins + 1)]).collect()})
    if len(edges) < 2:
        return train.sparkSession.createDataFrame(
            [], ("class int, " if per_class else "") + "bin int, lower double, upper double, n long, effect double, ale double")
    e = F.array(*[F.lit(float(x)) for x in edges])
    x = F.col(feature).cast("double")
    # bin index k in 1..K: number of interior edges strictly below x, at least 1
    k = F.greatest(F.size(F.filter(e, lambda b: b < x)), F.lit(1))
    binned = train.withColumn("_bin", k).withColumn("_lo", e[F.col("_bin") - 1]).withColumn("_hi", e[F.col("_bin")])
    # each row once per edge (side -1 and +1); the signed scores add up to the differences
    both = (binned.withColumn("_side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
            .withColumn(feature, F.when(F.col("_side") < 0, F.col("_lo")).otherwise(F.col("_hi"))))
    upper = F.col("_side") > 0
    scored, by = scorer(both), []
    if per_class:
        scored, by = scored.select("_bin", "_lo", "_hi", "_side", F.posexplode("probability").alias("class", "score")), ["class"]
    eff = scored.groupBy(*by, "_bin", "_lo", "_hi").agg(
        F.count_if(upper).alias("n"),
        (F.sum(F.col("_side") * F.col("score")) / F.count(F.when(upper, F.col("score")))).alias("effect"))
    # at most n_bins rows a class from here on: the windows are tiny
    order = Window.partitionBy(*by).orderBy("_bin")
    acc = eff.withColumn("_ale", F.sum("effect").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    acc = acc.withColumn("_prev", F.coalesce(F.lag("_ale").over(order), F.lit(0.0)))
    allb = Window.partitionBy(*by)
    centre = F.sum(F.col("n") * (F.col("_prev") + F.col("_ale")) / 2.0).over(allb) / F.sum("n").over(allb)
    return (acc.withColumn("_c", centre)
            .select(*by, F.col("_bin").alias("bin"), F.col("_lo").alias("lower"), F.col("_hi").alias("upper"),
                    "n", "effect", (F.col("_ale") - F.col("_c")).alias("ale")))


# ---------------------------------------------------------------- EX1 permutation importance

def probability_scorer(model) -> Scorer:
    """A fitted classifier: its class probabilities as an array column ``probability``."""
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.select(*df.columns, probability_array(out).alias("probability"))
    return score


def default_scoring(task: str, n_classes: int = 2) -> str:
    """R2 for numbers, log-loss for more than two classes, the area under the ROC curve for two."""
    return "r2" if task == "regression" else "neg_log_loss" if n_classes > 2 else "roc_auc"


def permutation_importance(train: DataFrame, feature_cols: Sequence[str], scorer: Scorer,
                           label: str = "label", id_col: str = "id", repeats: int = 5,
                           task: str = "classification", n_classes: int = 2, scoring: str | None = None, seed=0) -> DataFrame:
    """EX1: score drop after permuting one column, ``repeats`` times.

    The permutation of repeat r, shared by its features, maps the row at rank i
    of one seeded hash order to the row at rank i of a second one.  Both orders
    are salted with r (two H2 ranks of the rows and an equi-join on rank), so every
    repeat is a permutation of its own.  The rows are kept; a repeat is one query that
    scores its features in one pass, gives one number per feature and drops its shuffle
    files.  ``scoring`` (by task and classes unless given): ``roc_auc``
    (tie-aware, ranks of all features in one grouped pass, whose borders come from a
    permutation of some BORDER_ROWS rows), ``neg_log_loss`` (the scorer
    gives a ``probability`` array; probabilities below 1e-15 count as that),
    ``accuracy`` of the rounded score or ``r2``.  A single feature has importance 1.
    Output: feature, attribution (mean drop), std (population).
    """
    cols, spark = list(feature_cols), train.sparkSession
    scoring = scoring or default_scoring(task, n_classes)
    if len(cols) == 1:
        return spark.createDataFrame([(cols[0], 1.0, 0.0)], "feature string, attribution double, std double")
    rows = train.select(id_col, label, *cols).persist()
    drops: list[tuple] = []
    try:
        every = max(1, rows.count() // BORDER_ROWS)
        splits = None
        if scoring == "roc_auc":
            few = rows.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)
            splits = value_splits(scorer(_permuted(few, label, id_col, cols, 0, seed)), "score", 256)
        with shuffles_dropped(spark):
            base = [r["_m"] for r in _scored_metric(scorer(rows), scoring, label, [], splits).collect()]
            for r in range(repeats):
                per = _scored_metric(scorer(_permuted(rows, label, id_col, cols, r, seed)), scoring, label, ["_f"], splits)
                drops += [(cols[m["_f"]], base[0] - m["_m"] if None not in (base[0], m["_m"]) else None) for m in per.collect()]
    finally:
        rows.unpersist()
    return (spark.createDataFrame(drops, "feature string, d double").groupBy("feature")
            .agg(F.avg("d").alias("attribution"), F.stddev_pop("d").alias("std")))


def _permuted(rows: DataFrame, label: str, id_col: str, cols: list[str], repeat: int, seed) -> DataFrame:
    """``rows`` once per feature ``_f`` (its place in ``cols``), with that feature permuted."""
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(repeat)))
    a = row_number_by_hash(rows, key, f"{seed}-a", "_rank")
    b = row_number_by_hash(rows.select(id_col, *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(cols)]),
                           key, f"{seed}-b", "_rank").drop(id_col)
    both = a.join(b, "_rank").withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(cols))])))
    return both.select(id_col, label, "_f", *[F.when(F.col("_f") == i, F.col(f"_p{i}")).otherwise(F.col(c).cast("double")).alias(c)
                                              for i, c in enumerate(cols)])


def _scored_metric(scored: DataFrame, scoring: str, label: str, keys: list[str], splits: Sequence[float] | None = None) -> DataFrame:
    """``keys..., _m``: the metric of scored rows, the larger the better."""
    y = F.col(label).cast("double")
    if scoring == "roc_auc":
        from lucerna.operators.metrics import auc_ovr
        return auc_ovr(scored, label, "score", group_cols=keys, splits=splits).withColumnRenamed("auc", "_m")
    if scoring == "neg_log_loss":
        metric = F.avg(F.log(F.greatest(F.element_at("probability", y.cast("int") + 1), F.lit(1e-15))))
    elif scoring == "accuracy":
        metric = F.avg(F.when(F.round(F.col("score")) == y, 1.0).otherwise(0.0))
    elif scoring == "r2":
        metric = 1.0 - F.sum((y - F.col("score")) ** 2) / (F.var_pop(y) * F.count(F.lit(1)))
    else:
        raise ValueError(f"unknown scoring {scoring!r}")
    return scored.groupBy(*keys).agg(metric.alias("_m")) if keys else scored.agg(metric.alias("_m"))


# ---------------------------------------------------------------- EX2 forest importance

def forest_importance(test: DataFrame, feature_cols: Sequence[str], task: str,
                      label: str = "label", seed: int = 2020) -> DataFrame:
    """EX2: impurity importance of a random forest fitted on the given (test) rows."""
    from lucerna.operators.models import fit_model
    m = fit_model(test, "RF", task, feature_cols, params={"numTrees": 100}, label=label, seed=seed)
    imp = m.stages[-1].featureImportances.toArray().tolist()
    spark = test.sparkSession
    return spark.createDataFrame(list(zip(feature_cols, [float(x) for x in imp])),
                                 "feature string, attribution double")


# ---------------------------------------------------------------- EX15/EX16 anchors

def anchors(train: DataFrame, explain: DataFrame, feature_cols: Sequence[str],
            id_col: str = "id", pred_col: str = "prediction", threshold: float = 0.95) -> DataFrame:
    """EX15: per explained row, the anchor (conjunction of "feature in my quartile
    bin" predicates, of any size) with precision >= threshold; shortest
    first, then highest coverage, then rule text; none -> highest precision.

    Precision / coverage are empirical over the train rows (with their
    predictions).  Rows collapse to distinct bin vectors, and the search goes
    level by level: a level extends the conjunctions of the one before by one
    predicate, only for vectors without an anchor so far and only where a
    train row with the same prediction is still covered (a longer conjunction
    covers no others).  Covered train vectors come from a vertical index, (predicate,
    vector) rows, by equi-joins; rule texts are written for the winners alone.
    Output: id, rule, precision, coverage, size.
    """
    spark = train.sparkSession
    checkpoint_dir(spark)
    cols = list(feature_cols)
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                     F.col(c).cast("double").alias("value"))
                                            for c in cols])).alias("s")).select("s.*")
    qrows = exact_quantiles(long, "value", ["feature"], [0.25, 0.5, 0.75]).collect()
    q = {c: sorted(r["q"] for r in qrows if r["feature"] == c) for c in cols}

    def item(i: int, c: str) -> Column:
        """The row's predicate of a feature as a number: 4 i + quartile."""
        x, (q1, q2, q3) = F.col(c).cast("double"), q[c]
        return F.lit(4 * i) + F.when(x <= q1, 0).when(x <= q2, 1).when(x <= q3, 2).otherwise(3)

    def texts(c: str) -> list[str]:
        q1, q2, q3 = (f"{math.floor(v * 100.0 + 0.5) / 100.0:.2f}" for v in q[c])   # as exprs.rnd
        return [f"{c} <= {q1}", f"{q1} < {c} <= {q2}", f"{q2} < {c} <= {q3}", f"{c} > {q3}"]

    vector = F.array(*[item(i, c) for i, c in enumerate(cols)])
    cells = (train.groupBy(vector.alias("v"), F.col(pred_col).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("t", F.xxhash64("v")).checkpoint())
    n_train = cells.agg(F.sum("_c")).first()[0] or 0
    index = cells.select("t", F.explode("v").alias("i")).distinct().checkpoint()
    rows = explain.select(id_col, vector.alias("v"), F.col(pred_col).alias("_mine"))
    asked = rows.select("v", "_mine").distinct().withColumn("w", F.xxhash64("v", "_mine")).checkpoint()
    # one row per (vector asked for, conjunction): its items ascending, and the hash that names them
    level = asked.select("w", "_mine", "v", F.lit(0).cast("long").alias("before"), F.array().cast("array<int>").alias("items"))
    cover = cells.select(F.lit(0).cast("long").alias("before"), "t").distinct()
    parts = []
    for size in range(1, len(cols) + 1):
        later = F.filter("v", lambda x: x > F.element_at("items", -1)) if parts else F.col("v")
        level = (level.select("w", "_mine", "v", "before", "items", F.explode(later).alias("i"))
                 .select("w", "_mine", "v", "before", "i", F.concat("items", F.array("i")).alias("items"))
                 .withColumn("name", F.xxhash64("items")))
        wanted = level.select("before", "i", "name").distinct()
        cover = wanted.join(cover, "before").join(index, ["i", "t"]).select(F.col("name").alias("before"), "t").checkpoint()
        counts = (cover.join(cells.select("t", "_p", "_c"), "t").groupBy("before", "_p").agg(F.sum("_c").alias("_c"))
                  .withColumnRenamed("before", "name"))
        covered = counts.groupBy("name").agg(F.sum("_c").alias("_cov"))
        scored = (level.join(covered, "name", "left").join(counts.select("name", F.col("_p").alias("_mine"), "_c"), ["name", "_mine"], "left")
                  .select("w", "_mine", "v", F.col("name").alias("before"), "items", F.lit(size).alias("size"),
                          F.coalesce(F.col("_c") / F.col("_cov"), F.lit(0.0)).alias("precision"),
                          (F.coalesce(F.col("_cov"), F.lit(0)) / F.lit(float(n_train or 1))).alias("coverage"))).checkpoint()
        parts.append(scored)
        solved = scored.where(F.col("precision") >= threshold).select("w").distinct()
        level = scored.where("precision > 0").join(solved, "w", "left_anti").select("w", "_mine", "v", "before", "items")
        if level.isEmpty():
            break
    # of equal ones all stay: the rule texts decide between them
    ok = F.col("precision") >= threshold
    order = Window.partitionBy("w").orderBy(
        F.when(ok, 0).otherwise(1), F.when(ok, F.col("size")).otherwise(0), F.when(ok, -F.col("coverage")).otherwise(-F.col("precision")),
        F.col("size"), -F.col("coverage"))
    best = reduce(DataFrame.unionByName, parts).withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")
    said = F.array(*[F.lit(t) for c in cols for t in texts(c)])
    rule = F.concat_ws(" AND ", F.transform("items", lambda i: F.element_at(said, i + 1)))
    first = Window.partitionBy("w").orderBy("rule")
    won = (best.withColumn("rule", rule).withColumn("_r", F.row_number().over(first)).where("_r = 1")
           .select("w", "rule", "size", "precision", "coverage"))
    return rows.withColumn("w", F.xxhash64("v", "_mine")).join(won, "w").select(id_col, "rule", "size", "precision", "coverage")


def anchors_global(local: DataFrame) -> DataFrame:
    """EX16: per rule: mean / std (0 if undefined) of precision, summed coverage;
    attribution = mean precision."""
    return local.groupBy(F.col("rule").alias("feature")).agg(
        F.avg("precision").alias("precision"),
        F.coalesce(F.stddev_samp("precision"), F.lit(0.0)).alias("std"),
        F.sum("coverage").alias("coverage"),
        F.avg("precision").alias("attribution"))


# ---------------------------------------------------------------- EX18-EX22 table shaping

def sort_by_magnitude(df: DataFrame, col: str = "attribution") -> DataFrame:
    """EX18 / IO3: order by |attribution| desc, then feature."""
    return df.orderBy(F.abs(col).desc(), F.col("feature"))


def shorten_global(df: DataFrame, keys: Sequence[str] = (), n: int = TOP_FEATURES,
                   tail: str = "sum") -> DataFrame:
    """EX19 (tail = 'sum') / CO15 (tail = 'mean'): the first ``n`` features by
    |attribution| and one row ``Sum other K features`` for the rest.

    Applied per ``keys`` group only when the group has more than ``n`` features.
    Groups hold one row per feature, so the per-group Window is bounded.
    """
    w = Window.partitionBy(*keys).orderBy(F.abs("attribution").desc(), F.col("feature"))
    wc = Window.partitionBy(*keys)
    r = df.withColumn("_rn", F.row_number().over(w)).withColumn("_cnt", F.count(F.lit(1)).over(wc))
    head = r.where((F.col("_rn") <= n) | (F.col("_cnt") <= n)).select(*keys, "feature", "attribution")
    agg = F.sum if tail == "sum" else F.avg
    rest = (r.where((F.col("_rn") > n) & (F.col("_cnt") > n)).groupBy(*keys, "_cnt")
            .agg(agg("attribution").alias("attribution"))
            .select(*keys, F.concat(F.lit("Sum other "), (F.col("_cnt") - n).cast("string"),
                                    F.lit(" features")).alias("feature"), "attribution"))
    return head.unionByName(rest)


def summarise_local(df: DataFrame, keys: Sequence[str], n: int = TOP_FEATURES) -> DataFrame:
    """EX20: per sample, the first ``n`` rows in the given order (``rank`` column),
    the rest summed into one row; rows then ranked by signed value desc."""
    r = df.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    head = r.where((F.col("rank") <= n) | (F.col("_cnt") <= n)).select(*keys, "feature", "attribution")
    rest = (r.where((F.col("rank") > n) & (F.col("_cnt") > n)).groupBy(*keys, "_cnt")
            .agg(F.sum("attribution").alias("attribution"))
            .select(*keys, F.concat(F.lit("Sum other "), (F.col("_cnt") - n).cast("string"),
                                    F.lit(" features")).alias("feature"), "attribution"))
    out = head.unionByName(rest)
    w = Window.partitionBy(*keys).orderBy(F.col("attribution").desc(), F.col("feature"))
    return out.withColumn("position", F.row_number().over(w).cast("long"))


def sample_confidence(scored: DataFrame, id_col: str = "id", task: str = "classification") -> DataFrame:
    """EX21: max class probability per explained row (regression: the prediction)."""
    if task == "classification":
        return scored.select(id_col, F.array_max("probability").alias("confidence"))
    return scored.select(id_col, F.col("prediction").cast("double").alias("confidence"))


def attribution_share(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EX22: percentage of the summed |attribution| per feature (pie data)."""
    tot = df.groupBy(*keys).agg(F.sum(F.abs("attribution")).alias("_t"))
    j = df.join(tot, list(keys)) if keys else with_scalars(df, tot)
    return j.select(*keys, "feature", F.when(F.col("_t") == 0, 0.0)
                    .otherwise(100.0 * F.abs("attribution") / F.col("_t")).alias("share"))


def lime_global(lime_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EX4: feature parsed out of the condition text, then mean and sample std
    of the local weights per feature."""
    num = r"-?[0-9]+(\.[0-9]+)?"
    op = r"(<=|>=|<|>|=)"
    name = F.trim(F.regexp_replace(F.regexp_replace(F.col("range"), f"^{num}\\s*{op}\\s*", ""),
                                   f"\\s*{op}\\s*{num}$", ""))
    return (lime_rows.withColumn("feature", name).groupBy(*keys, "feature")
            .agg(F.avg("attribution").alias("attribution"), F.stddev_samp("attribution").alias("std")))


def dice_importance(cf: DataFrame, keys: Sequence[str] = (), id_col: str = "id", feature_cols: Sequence[str] | None = None) -> DataFrame:
    """EX11: per row, the share of its counterfactuals that change each feature;
    globally the mean and population std of those shares.

    ``cf`` has one row per counterfactual and feature; with ``feature_cols`` one row per
    counterfactual, as :func:`kept_counterfactuals` gives it, and the shares are
    worked out without a row per feature.
    """
    if feature_cols is not None:
        shares = [F.avg(F.col("s")[i]["changed"].cast("double")) for i in range(len(feature_cols))]
        each = F.array(*[F.struct(F.lit(c).alias("feature"), x.alias("attribution")) for c, x in zip(feature_cols, shares, strict=True)])
        local = cf.groupBy(*keys, id_col).agg(each.alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    else:
        local = cf.groupBy(*keys, id_col, "feature").agg(F.avg(F.col("changed").cast("double")).alias("attribution"))
    glob = local.groupBy(*keys, "feature").agg(F.avg("attribution").alias("attribution"),
                                               F.stddev_pop("attribution").alias("std"))
    return glob


CANDIDATE_ROWS = 1000  # rows whose candidates a task holds at once


def _candidates(id_col: str, cols: list[str], others: list[str], bounds: list[tuple[float, float]], limit: int, n_candidates: int, seed):
    """Rows with ``_key`` (the id's text) to their candidates that change something, in the rows' order."""
    changes = [[f"-{seed}-{j}-{c}".encode() for j in range(n_candidates)] for c in cols]
    draws = [[f"-{seed}-v-{j}-{c}".encode() for j in range(n_candidates)] for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(at, CANDIDATE_ROWS)
                n = part.num_rows
                names = part.column("_key")
                groups = group + np.cumsum([last is None or names[0].as_py() != last,
                                            *pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
                group, last = int(groups[-1]), names[n - 1].as_py()
                keys = Keys(names)
                moved = [keys.first32(s).astype(np.int64) < limit for s in changes]
                count = sum((m.astype(np.int32) for m in moved), np.zeros((n_candidates, n), np.int32))
                row, cf = np.nonzero(count.T)
                mask, dist, missing, out = np.zeros(len(row), np.int64), np.zeros(len(row)), np.zeros(len(row), bool), []
                for i, c in enumerate(cols):
                    x = part.column(c)
                    own, unknown = x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)
                    of = np.flatnonzero(moved[i][cf, row])
                    lo, hi = bounds[i]
                    drawn = lo + (hi - lo) * (keys.first32_at(draws[i], cf[of], row[of]) / TWO_32)
                    value, gone = own[row], unknown[row]
                    far = np.zeros(len(row))
                    far[of] = np.abs(drawn - value[of]) / ((hi - lo) or 1.0)
                    dist += far
                    missing[of] |= gone[of]
                    value[of], gone[of] = drawn, False
                    mask[of] |= 1 << i
                    out.append(pa.array(value, mask=gone) if gone.any() else pa.array(value))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(row) for c in others], *out, pa.array(cf.astype(np.int32)), pa.array(groups[row.to_numpy()]),
                     pa.array(count[cf, row.to_numpy()]), pa.array(dist, mask=missing), pa.array(mask)],
                    [*others, *cols, "cf", "_group", "_nchg", "_dist", "_mask"])
    run.__name__ = f"candidates_changed_below_{limit:08x}"
    return run


def _best(n_keep: int):
    """The best ``n_keep`` candidates of every group of rows that follow one another."""
    def cut(held: pa.Table) -> pa.Table:
        group, dist = held.column("_group").to_numpy(), held.column("_dist")
        known = dist.is_valid().to_numpy()  # an unknown distance goes first, as in the engine's order
        order = np.lexsort((held.column("cf").to_numpy(), dist.fill_null(0.0).to_numpy(), known, held.column("_nchg").to_numpy(), group))
        group = group[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        return held.take(pa.array(order[rank < n_keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                group = held.column("_group").to_numpy()
                if (group[1:] < group[:-1]).any():
                    raise ValueError("the scorer must keep the rows in their order")
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
                if done:
                    yield from cut(held.slice(0, done)).to_batches()
                held = cut(held.slice(done))
        if held is not None:
            yield from held.to_batches()
    return run


def kept_counterfactuals(rows: DataFrame, train: DataFrame, feature_cols: Sequence[str], scorer: Scorer,
                         desired: Callable[[Column, Column], Column], id_col: str = "id",
                         n_candidates: int = 100, n_keep: int = 10, change_prob: float = 0.3,
                         seed=0) -> DataFrame:
    """The rows of :func:`counterfactuals` before they are made long: id, cf and ``s``, an array of (feature, value, changed)."""
    cols = list(feature_cols)
    rng = train.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
                                                   F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]).first()
    bounds = [(rng[f"lo_{c}"], rng[f"hi_{c}"]) for c in cols]
    limit = min(max(math.ceil(change_prob * 2 ** 32), 0), 2 ** 32)
    # rows of one id follow one another: they share the candidates that are kept; a null id has no hash, so nothing of it changes
    near = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != id_col])).alias("_same"))
    near = near.select(id_col, F.explode("_same").alias("_row")).select(*[F.col(c) if c == id_col else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])
    orig = scorer(near).select(*rows.columns, F.col("score").alias("_orig"))
    others = [c for c in orig.columns if c not in cols]
    given = orig.select(*others, *[F.col(c).cast("double").alias(c) for c in cols], F.col(id_col).cast("string").alias("_key"))
    kind = ", ".join([*[f"`{c}` {given.schema[c].dataType.simpleString()}" for c in others], *[f"`{c}` double" for c in cols],
                      "cf int, _group long, _nchg int, _dist double, _mask long"])
    cand = given.mapInArrow(_candidates(id_col, cols, others, bounds, limit, n_candidates, seed), kind)
    lean = [id_col, "cf", *[c for c in cols if c != id_col], "_group", "_nchg", "_dist", "_mask"]
    scored = scorer(cand).where(desired(F.col("score"), F.col("_orig"))).select(*lean)
    kept = scored.mapInArrow(_best(n_keep), scored.schema)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                             (F.shiftright("_mask", i) % 2 == 1).alias("changed")) for i, c in enumerate(cols)])
    return kept.select(id_col, "cf", arr.alias("s"))


def counterfactuals(rows: DataFrame, train: DataFrame, feature_cols: Sequence[str], scorer: Scorer,
                    desired: Callable[[Column, Column], Column], id_col: str = "id",
                    n_candidates: int = 100, n_keep: int = 10, change_prob: float = 0.3,
                    seed=0) -> DataFrame:
    """EX10: seeded random-search counterfactuals.

    Each row gets ``n_candidates`` candidates; candidate j changes feature f
    when H1(id, j, f) < change_prob, to a value uniform in the training
    [min, max] of f.  Candidates whose score satisfies ``desired(score,
    original_score)`` are kept, the best ``n_keep`` by (features changed,
    L1 distance in range units).  Output long: id, cf, feature, value, changed.

    Hashes of many rows and candidates are worked out together (:mod:`lucerna.functions.md5`).
    The scorer adds its column row by row; the candidates of an id stay side by
    side, so the best of them are found without a shuffle of candidates.
    """
    kept = kept_counterfactuals(rows, train, feature_cols, scorer, desired, id_col, n_candidates, n_keep, change_prob, seed)
    return kept.select(id_col, "cf", F.explode("s").alias("s")).select(id_col, "cf", "s.*")


def round_cols(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*[rnd(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- EX3 LIME

def lime_local(rows: DataFrame, train: DataFrame, feature_cols: Sequence[str], scorer: Scorer | dict[int, Scorer],
               id_col: str = "id", label: str | None = None, num_features: int | None = None, n_samples: int = 5000,
               alpha: float = 1.0, seed=0) -> DataFrame:
    """EX3: LIME with discretised features, forward selection and a weighted local ridge per row.

    Features are cut by entropy where ``label`` names the training classes (the
    classification case), else at the quartiles.  Sample j draws, per feature, an
    interval with the training frequencies (H1) and takes that interval's
    training mean; z_f = 1 when the drawn interval is the row's.  Weight sqrt(exp(-d^2 /
    width^2)), d = distance of z to the row's all-ones vector, width = 0.75 sqrt(d).
    The samples are drawn and scored once for all rows (common random numbers), and
    every row adds itself as one more sample.  A row's normal equations depend on
    its intervals and score alone, so rows are solved where they are, without a shuffle.

    With several scorers (class -> scorer) a row is explained for its class of
    the highest score.  Forward selection keeps the ``num_features`` features (all by
    default) that raise the weighted R2 most, one after the other.
    Output: id, feature, attribution, range, class, local_prediction.
    """
    from lucerna.functions.local_fit import lime_solver
    from lucerna.operators.discretise import entropy_cuts, quartile_cuts, range_texts
    spark = train.sparkSession
    cols = list(feature_cols)
    scorers = scorer if isinstance(scorer, dict) else {1: scorer}
    classes = sorted(scorers)
    cuts = entropy_cuts(train, cols, label) if label else quartile_cuts(train, cols)

    def interval(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.size(F.filter(F.array(*[F.lit(e) for e in cuts[c]]).cast("array<double>"), lambda e: e < x))
    # training frequency and mean of every interval: features x (cuts + 1) rows
    stat: dict[tuple[str, int], tuple[int, float]] = {}
    for r in (train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), interval(c).alias("b"), F.col(c).cast("double").alias("v"))
                                               for c in cols])).alias("s"))
              .where("s.v is not null").groupBy("s.f", "s.b").agg(F.count(F.lit(1)).alias("n"), F.avg("s.v").alias("m")).collect()):
        stat[(r["f"], r["b"])] = (r["n"], r["m"])
    drawn, means = [], []
    for c in cols:
        size = len(cuts[c]) + 1
        total = sum(stat.get((c, b), (0, 0.0))[0] for b in range(size)) or 1
        u, upto, bins = hash_uniform(F.col("_j"), seed, c), 0, F.lit(size - 1)
        edges = []
        for b in range(size):
            upto += stat.get((c, b), (0, 0.0))[0]
            edges.append(upto / total)
        for b in reversed(range(size - 1)):
            bins = F.when(u < edges[b], b).otherwise(bins)
        drawn.append(bins.alias(f"d_{c}"))
        mean = F.array(*[F.lit(float(stat.get((c, b), (0, 0.0))[1])) for b in range(size)])
        means.append(F.element_at(mean, F.col(f"d_{c}") + 1).alias(c))
    points = spark.range(1, n_samples).withColumnRenamed("id", "_j").select("_j", *drawn).select(
        F.col("_j").alias(id_col), *[f"d_{c}" for c in cols], *means)
    scored = points.select(id_col, *[f"d_{c}" for c in cols]).toPandas().set_index(id_col)
    for y in classes:  # n_samples numbers a class
        got = scorers[y](points).select(id_col, F.col("score").cast("double").alias(f"y_{y}")).toPandas().set_index(id_col)
        scored = scored.join(got)
    own = rows.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols], *[interval(c).alias(f"d_{c}") for c in cols])
    for y in classes:
        own = scorers[y](own).withColumnRenamed("score", f"y_{y}")
    keep = [id_col, *[f"d_{c}" for c in cols], *[f"y_{y}" for y in classes]]
    solve = lime_solver(scored[[f"d_{c}" for c in cols]].to_numpy(), scored[[f"y_{y}" for y in classes]].to_numpy(float), id_col, cols,
                        classes, alpha, num_features or len(cols))
    kind = rows.schema[id_col].dataType.simpleString()
    fit = own.select(*keep).mapInPandas(solve, f"id {kind}, feature string, attribution double, bin int, class int, local_prediction double")
    said = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*[F.lit(t) for t in range_texts(c, cuts[c])]))])
    return fit.select("id", "feature", "attribution", F.element_at(F.element_at(said, F.col("feature")), F.col("bin") + 1).alias("range"),
                      "class", "local_prediction")


# ---------------------------------------------------------------- EX6 sampled Shapley

def sampled_shapley(rows: DataFrame, background: DataFrame, feature_cols: Sequence[str], scorer: Scorer,
                    id_col: str = "id", n_draws: int = 32, n_background: int = 100, seed=0) -> DataFrame:
    """EX6 for any model: permutation sampling (Strumbelj & Kononenko).

    Draw j of row x: a seeded feature order pi_j and a background row b_j
    (one of the first ``n_background`` rows of the background in hash order
    -- the background summary).  Walking pi_j, features switch from b_j to
    x one at a time (d + 1 scored points); the score difference of each step
    is that feature's contribution.  Values are the mean over draws, so
    sum_f phi_f = f(x) - mean_j f(b_j).  Output: id, feature, attribution.
    """
    cols = list(feature_cols)
    d = len(cols)
    checkpoint_dir(rows.sparkSession)
    bg = (row_number_by_hash(background.select(id_col, *cols), id_col, f"{seed}-bg", "_bi")
          .where(F.col("_bi") <= n_background)
          .select("_bi", *[F.col(c).cast("double").alias(f"b_{c}") for c in cols]).checkpoint())
    n_bg, bg_null = bg.agg(F.count(F.lit(1)), F.count_if(reduce(lambda p, q: p | q, [F.col(f"b_{c}").isNull() for c in cols]))).first()
    x = rows.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in cols])

    def points(some: DataFrame) -> DataFrame:
        ex = some.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
        ex = ex.withColumn("_bi", (F.floor(hash_uniform("id", f"{seed}-b", F.col("_j")) * n_bg) + 1).cast("long"))
        ex = ex.select("*", *[hash_uniform("id", f"{seed}-p", F.col("_j"), c).alias(f"_h_{c}") for c in cols])
        pos = []
        for i, c in enumerate(cols):
            p = F.lit(0)
            for k, o in enumerate(cols):
                if o != c:
                    mine, other = F.col(f"_h_{c}"), F.col(f"_h_{o}")
                    p = p + F.when((other < mine) | ((other == mine) & F.lit(k < i)), 1).otherwise(0)
            pos.append(p.alias(f"_pos_{c}"))
        ex = ex.select("id", "_j", "_bi", *cols, *pos)
        # background rows: at most n_background rows, a proven-small broadcast
        ex = ex.join(F.broadcast(bg), "_bi").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(d))))
        return ex.select("id", "_j", "_k", *[F.when(F.col(f"_pos_{c}") < F.col("_k"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
                                             for c in cols], *[f"_pos_{c}" for c in cols])

    def summed(scored: DataFrame) -> DataFrame:
        """Scores after a feature switched less those before, folded by id before the shuffle; copies of an id count as one."""
        signed = [F.sum(F.when(F.col(f"_pos_{c}") == F.col("_k") - 1, F.col("score"))
                        .when(F.col(f"_pos_{c}") == F.col("_k"), -F.col("score"))).alias(f"_s{i}") for i, c in enumerate(cols)]
        by = scored.groupBy("id").agg(F.count_if(F.col("_k") == 0).alias("_n"), *signed)
        each = [F.struct(F.lit(c).alias("feature"), (F.col(f"_s{i}") / F.col("_n")).alias("attribution")) for i, c in enumerate(cols)]
        return by.select("id", F.explode(F.array(*each)).alias("s")).select("id", "s.*")

    def stepped(scored: DataFrame) -> DataFrame:
        """The same step by step: a step from or to a point without a score counts for nothing."""
        w = Window.partitionBy("id", "_j").orderBy("_k")   # d + 1 rows per partition
        steps = scored.withColumn("_delta", F.col("score") - F.lag("score").over(w)).where(F.col("_k") >= 1)
        feat = F.lit(None).cast("string")
        for c in cols:
            feat = F.when(F.col(f"_pos_{c}") == F.col("_k") - 1, F.lit(c)).otherwise(feat)
        return (steps.select("id", feat.alias("feature"), "_delta")
                .groupBy("id", "feature").agg((F.sum("_delta") / F.lit(float(n_draws))).alias("attribution")))

    if bg_null:
        return stepped(scorer(points(x)))
    gone = reduce(lambda p, q: p | q, [F.col(c).isNull() for c in cols])
    return summed(scorer(points(x.where(~gone)))).unionByName(stepped(scorer(points(x.where(gone)))))


# ---------------------------------------------------------------- EX17 learning curve

def learning_curve(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], model_name: str,
                   task: str = "classification", label: str = "label", id_col: str = "id",
                   fractions: Sequence[float] = tuple(i / 10 for i in range(1, 11)), seed=0) -> DataFrame:
    """EX17: train / test score on nested training prefixes (seeded hash order).

    Score = accuracy (classification) or mean squared error (regression).
    """
    from lucerna.operators.models import fit_model, predict
    ranked = row_number_by_hash(train, id_col, f"{seed}-lc", "_rn").persist()
    n = ranked.count()
    rows = []
    for fr in fractions:
        k = max(1, int(n * fr))
        part = ranked.where(F.col("_rn") <= k).drop("_rn")
        m = fit_model(part, model_name, task, feature_cols, label=label)
        for name, df in (("train", part), ("test", test)):
            s = predict(m, df, keep=[label])
            if task == "classification":
                v = s.agg(F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))).first()[0]
            else:
                v = s.agg(F.avg((F.col("prediction") - F.col(label)) ** 2)).first()[0]
            rows.append((float(fr), int(k), name, float(v)))
    ranked.unpersist()
    return train.sparkSession.createDataFrame(rows, "fraction double, n_train int, split string, score double")
