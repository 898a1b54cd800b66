"""EV1-EV20: evaluation metrics as aggregations.

Input: a scored table with ``label``, ``prediction`` and optionally
``probability`` (class-1 probability for binary tasks, an array of class
probabilities for multiclass).  Every metric is a grouped aggregate with
map-side partial aggregation; nothing but metric values reaches the driver.

Conventions (fixed): accuracy, precision, F1, recall and specificity are
percentages; all bundle values are rounded to 3 decimals; 0/0 gives 0;
binary AUC is taken from the hard labels, (TPR + TNR) / 2; multiclass AUC
is the macro one-vs-rest AUC of the probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd, safe_div, with_scalars
from lucerna.functions.ranking import BUCKET, running_sums, with_value_bucket

EPS64 = 2.220446049250313e-16  # float64 machine epsilon (MAPE floor)

CLASSIFICATION_METRICS = ["Accuracy", "Precision", "F1", "Recall", "Specificity", "Auc", "MCC"]
REGRESSION_METRICS = ["Pearson Correlation Coefficient", "Coefficient of Determination",
                      "Mean Absolute Error", "Mean Squared Error", "Root Mean Squared Error",
                      "Mean Absolute Percentage Error"]


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _to_long(df: DataFrame, group_cols: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                    for k, v in metrics.items()])
    return df.select(*group_cols, F.explode(arr).alias("m")).select(*group_cols, "m.metric", "m.value")


def _ind(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def binary_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """EV1 (binary): one row per group with ``tn, fp, fn, tp, n``."""
    l, p = F.col(label), F.col(prediction)
    return df.groupBy(*group_cols).agg(
        F.sum(_ind((l == 0) & (p == 0))).cast("long").alias("tn"),
        F.sum(_ind((l == 0) & (p == 1))).cast("long").alias("fp"),
        F.sum(_ind((l == 1) & (p == 0))).cast("long").alias("fn"),
        F.sum(_ind((l == 1) & (p == 1))).cast("long").alias("tp"),
        F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """EV1 (multiclass): one 2x2 matrix per class, ``class, tn, fp, fn, tp``.

    The class set is the union of true and predicted labels.
    """
    cm = df.groupBy(*group_cols, F.col(label).alias("_l"), F.col(prediction).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    side = F.explode(F.array(
        F.struct(F.col("_l").alias("class"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("pp"),
                 F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("pp"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")
    per = (cm.select(*group_cols, side).select(*group_cols, "s.*")
           .groupBy(*group_cols, "class").agg(F.sum("t").alias("t"), F.sum("pp").alias("pp"),
                                               F.sum("tp").alias("tp")))
    # rows per group = sum over its (few) classes: a window over the tiny class table
    out = per.withColumn("n", F.sum("t").over(Window.partitionBy(*group_cols)))
    return out.select(*group_cols, "class",
                      (F.col("n") - F.col("t") - F.col("pp") + F.col("tp")).cast("long").alias("tn"),
                      (F.col("pp") - F.col("tp")).cast("long").alias("fp"),
                      (F.col("t") - F.col("tp")).cast("long").alias("fn"),
                      F.col("tp").cast("long").alias("tp"),
                      F.col("n").cast("long").alias("n"))


def _binary_metric_cols(tn, fp, fn, tp) -> dict[str, Column]:
    tn, fp, fn, tp = (_d(c) for c in (tn, fp, fn, tp))
    n = tn + fp + fn + tp
    tpr = safe_div(tp, tp + fn)
    tnr = safe_div(tn, tn + fp)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "Accuracy": rnd(100.0 * safe_div(tp + tn, n), 3),
        "Precision": rnd(100.0 * safe_div(tp, tp + fp), 3),
        "F1": rnd(100.0 * safe_div(2.0 * tp, 2.0 * tp + fp + fn), 3),
        "Recall": rnd(100.0 * tpr, 3),
        "Specificity": rnd(100.0 * tnr, 3),
        "Auc": F.when(((tp + fn) > 0) & ((tn + fp) > 0), rnd((tpr + tnr) / 2.0, 3)),
        "MCC": rnd(safe_div(tp * tn - fp * fn, den), 3),
    }


def auc_ovr(scored: DataFrame, label: str = "label", score: str = "score",
            class_col: str | None = None, group_cols: Sequence[str] = (),
            n_buckets: int = 256, splits: Sequence[float] | None = None) -> DataFrame:
    """EV8: tie-aware AUC (Mann-Whitney) per group (and class).

    ``scored`` has one row per (sample[, class]) with a numeric ``score`` and
    a 0/1 ``label`` (positive = this class).  Rows collapse to one row per
    distinct score first (hot scores become one row).  A positive meets the
    negatives below it in its bucket of scores by a running sum, and those of lower
    buckets as one number per bucket, so no row is joined.  ``splits`` are the
    buckets' borders; without them the scores are read once more to find some.
    """
    keys = list(group_cols) + ([class_col] if class_col else [])
    dist = scored.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(_d(label)).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    dist = dist.withColumn("_neg", F.col("_cnt") - F.col("_pos"))
    keyed = with_value_bucket(dist, "_s", n_buckets, splits)
    inside = (Window.partitionBy(*keys, BUCKET).orderBy("_s")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = keyed.withColumn("_negcum", F.sum("_neg").over(inside)).groupBy(*keys, BUCKET).agg(
        F.sum(F.col("_pos") * (F.col("_negcum") - F.col("_neg") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    # at most n_buckets rows a group from here on
    below = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(F.sum("_N").over(below), F.lit(0.0)))
    part = per.groupBy(*keys).agg(F.sum(F.col("_u") + F.col("_P") * F.col("_below")).alias("_u"),
                                  F.sum("_P").alias("_P"), F.sum("_N").alias("_N"))
    return part.select(*keys, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                     F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auc"))


def _multiclass_auc(df: DataFrame, label: str, probability: str,
                    group_cols: Sequence[str]) -> DataFrame:
    long = df.select(*group_cols, F.col(label).alias("_y"),
                     F.posexplode(F.col(probability)).alias("class", "score"))
    long = long.withColumn("is_pos", F.when(F.col("_y") == F.col("class"), 1).otherwise(0))
    # only classes that occur as a true label count (label_binarize on y_true)
    present = df.select(*group_cols, F.col(label).alias("class")).distinct()
    per = auc_ovr(long, "is_pos", "score", "class", group_cols)
    per = per.join(present, [*group_cols, "class"])
    return per.groupBy(*group_cols).agg(F.avg("auc").alias("Auc"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           probability: str | None = None, group_cols: Sequence[str] = (),
                           multiclass: bool = False) -> DataFrame:
    """EV20 (classification): the long table ``group..., metric, value``."""
    g = list(group_cols)
    if not multiclass:
        c = binary_counts(df, label, prediction, g)
        return _to_long(c, g, _binary_metric_cols("tn", "fp", "fn", "tp"))
    per = class_counts(df, label, prediction, g)
    tp, fp, fn, tn = (_d(x) for x in ("tp", "fp", "fn", "tn"))
    t, pp = tp + fn, tp + fp
    agg = per.groupBy(*g).agg(
        F.first("n").cast("double").alias("n"),
        F.sum(tp).alias("c"),
        F.avg(safe_div(tp, pp)).alias("prec"),
        F.avg(safe_div(tp, t)).alias("rec"),
        F.avg(safe_div(2.0 * tp, pp + t)).alias("f1"),
        F.avg(safe_div(tn, tn + fp)).alias("spec"),
        F.sum(pp * pp).alias("sp2"), F.sum(t * t).alias("st2"), F.sum(pp * t).alias("spt"))
    if probability is not None:
        auc = _multiclass_auc(df, label, probability, g)
        agg = agg.join(auc, g, "left") if g else with_scalars(agg, auc)
    else:
        agg = agg.withColumn("Auc", F.lit(None).cast("double"))
    n, c = F.col("n"), F.col("c")
    den = F.sqrt((n * n - F.col("sp2")) * (n * n - F.col("st2")))
    metrics = {
        "Accuracy": rnd(100.0 * safe_div(c, n), 3),
        "Precision": rnd(100.0 * F.col("prec"), 3),
        "F1": rnd(100.0 * F.col("f1"), 3),
        "Recall": rnd(100.0 * F.col("rec"), 3),
        "Specificity": rnd(100.0 * F.col("spec"), 3),
        "Auc": rnd(F.col("Auc"), 3),
        "MCC": rnd(safe_div(c * n - F.col("spt"), den), 3),
    }
    return _to_long(agg, g, metrics)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """EV10-EV15, EV20 (regression): long table of the six regression metrics.

    The Pearson coefficient is reported as r x 100 (its p-value is
    :func:`pearson_p_value`).
    """
    g = list(group_cols)
    y, p = _d(label), _d(prediction)
    err = y - p
    agg = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(y, p).alias("r"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPS64))).alias("mape"),
        F.sum(err * err).alias("ssres"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sstot"))
    r2 = (F.when(F.col("sstot") == 0, F.when(F.col("ssres") == 0, 1.0).otherwise(0.0))
          .otherwise(1.0 - F.col("ssres") / F.col("sstot")))
    metrics = {
        "Pearson Correlation Coefficient": rnd(F.col("r") * 100.0, 3),
        "Coefficient of Determination": rnd(r2, 3),
        "Mean Absolute Error": rnd(F.col("mae"), 3),
        "Mean Squared Error": rnd(F.col("mse"), 3),
        "Root Mean Squared Error": rnd(F.sqrt(F.col("mse")), 3),
        "Mean Absolute Percentage Error": rnd(F.col("mape"), 3),
    }
    return _to_long(agg, g, metrics)


def pearson_p_value(df: DataFrame, label: str = "label", prediction: str = "prediction",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """EV15: two-sided p-value of Pearson's r (Student t with n-2 dof).

    The t survival function is evaluated on the aggregated rows only (one per
    group) with a vectorised pandas UDF.
    """
    from lucerna.functions.udfs import t_test_p_value

    g = list(group_cols)
    agg = df.groupBy(*g).agg(F.corr(_d(label), _d(prediction)).alias("r"),
                             F.count(F.lit(1)).cast("double").alias("n"))
    return agg.select(*g, "r", t_test_p_value("r", "n").alias("p_value"))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score",
               class_col: str | None = None, group_cols: Sequence[str] = (),
               n_buckets: int = 256) -> DataFrame:
    """EV16: one ROC point per distinct score: ``threshold, fpr, tpr``.

    Points are (share of negatives, share of positives) with score >= threshold,
    i.e. running sums in *descending* score order, computed distributed.
    """
    keys = list(group_cols) + ([class_col] if class_col else [])
    dist = scored.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(_d(label)).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    dist = dist.withColumn("_neg", F.col("_cnt") - F.col("_pos")).withColumn("_desc", -F.col("threshold"))
    keyed = with_value_bucket(dist, "_desc", n_buckets)
    run = running_sums(keyed, ["_desc"], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, keys)
    totals = dist.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    tot = run.join(totals, keys) if keys else with_scalars(run, totals)  # 1 row
    return tot.select(*keys, "threshold",
                      rnd(safe_div("_fp", "_N")).alias("fpr"),
                      rnd(safe_div("_tp", "_P")).alias("tpr"))


def class_probability_histogram(df: DataFrame, label: str = "label",
                                probability: str = "probability") -> DataFrame:
    """EV18: 10-bin histogram of class-1 probabilities split by true label.

    Bin = least(floor(p * 10), 9); all ten bins are returned (zero counts kept).
    """
    b = F.least(F.floor(_d(probability) * 10.0), F.lit(9)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(
        F.sum(_ind(F.col(label) == 0)).cast("long").alias("n_class0"),
        F.sum(_ind(F.col(label) == 1)).cast("long").alias("n_class1"))
    bins = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counts, "bin", "left")
            .select("bin", F.coalesce("n_class0", F.lit(0)).cast("long").alias("n_class0"),
                    F.coalesce("n_class1", F.lit(0)).cast("long").alias("n_class1")))


def prediction_density(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       width: float = 50000.0) -> DataFrame:
    """EV19: predicted-vs-true pairs as a 2-D density table of ``width`` cells."""
    return df.groupBy(F.floor(_d(prediction) / width).cast("long").alias("pred_bin"),
                      F.floor(_d(label) / width).cast("long").alias("true_bin")).agg(
        F.count(F.lit(1)).alias("n"))
