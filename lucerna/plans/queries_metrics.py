"""Queries for the evaluation metrics (EV1-EV20) and role assignment (IO2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import metrics as M
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, binary_metrics_sql, with_views
from lucerna.sources.tables import Roles, role_summary


def _sdiv(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


@query("io_role_summary", "IO2", with_views(
    "SELECT COUNT(*) AS n_rows, CAST(6 AS BIGINT) AS n_features, "
    "CAST(COUNT(DISTINCT label) AS BIGINT) AS n_classes FROM order_multi", "order_multi"))
def io_role_summary(v):
    df = v.order_multi.select("id", *FEATURES, "label")
    return role_summary(df, Roles.positional(df))


@query("ev_confusion_binary", "EV1", with_views("""
SELECT CAST(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       COUNT(*) AS n FROM order_pred""", "order_pred"))
def ev_confusion_binary(v):
    return M.binary_counts(v.order_pred)


_CLASS_COUNTS = """
cm AS (SELECT label AS _l, prediction AS _p, COUNT(*) AS _n FROM {src} GROUP BY 1, 2),
per AS (SELECT class, SUM(t) AS t, SUM(pp) AS pp, SUM(tp) AS tp FROM (
          SELECT _l AS class, _n AS t, 0 AS pp, CASE WHEN _l = _p THEN _n ELSE 0 END AS tp FROM cm
          UNION ALL SELECT _p AS class, 0 AS t, _n AS pp, 0 AS tp FROM cm) u GROUP BY class),
tot AS (SELECT SUM(_n) AS n FROM cm),
cc AS (SELECT class, CAST(n - t - pp + tp AS BIGINT) AS tn, CAST(pp - tp AS BIGINT) AS fp,
              CAST(t - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n
       FROM per, tot)"""


@query("ev_confusion_multiclass", "EV1", with_views(
    "SELECT * FROM (WITH " + _CLASS_COUNTS.format(src="order_pred_multi") + " SELECT * FROM cc) q",
    "order_pred_multi"))
def ev_confusion_multiclass(v):
    return M.class_counts(v.order_pred_multi)


@query("ev_metrics_binary", "EV2,EV3,EV4,EV5,EV6,EV7,EV9,EV20", with_views(
    f"SELECT * FROM {binary_metrics_sql('order_pred', [])} m", "order_pred"))
def ev_metrics_binary(v):
    return M.classification_metrics(v.order_pred)


_MULTI_SQL = "SELECT * FROM (WITH " + _CLASS_COUNTS.format(src="order_pred_multi") + f""",
d AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
             CAST(tn AS DOUBLE) AS tn, CAST(n AS DOUBLE) AS n FROM cc),
agg AS (SELECT max(n) AS n, sum(tp) AS c,
               avg({_sdiv('tp', 'tp + fp')}) AS prec, avg({_sdiv('tp', 'tp + fn')}) AS rec,
               avg({_sdiv('2.0 * tp', '2.0 * tp + fp + fn')}) AS f1, avg({_sdiv('tn', 'tn + fp')}) AS spec,
               sum((tp + fp) * (tp + fp)) AS sp2, sum((tp + fn) * (tp + fn)) AS st2,
               sum((tp + fp) * (tp + fn)) AS spt FROM d),
lng AS (SELECT label, 0 AS class, p0 AS score FROM order_pred_multi
        UNION ALL SELECT label, 1, p1 FROM order_pred_multi
        UNION ALL SELECT label, 2, p2 FROM order_pred_multi),
ds AS (SELECT class, score, CAST(SUM(CASE WHEN label = class THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
              CAST(COUNT(*) AS DOUBLE) AS cnt FROM lng GROUP BY 1, 2),
rs AS (SELECT class, pos, cnt - pos AS neg,
              SUM(cnt - pos) OVER (PARTITION BY class ORDER BY score ROWS UNBOUNDED PRECEDING) AS negcum
       FROM ds),
pa AS (SELECT class, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
                     THEN SUM(pos * (negcum - neg + neg / 2.0)) / (SUM(pos) * SUM(neg)) END AS auc
       FROM rs GROUP BY class),
au AS (SELECT avg(auc) AS auc FROM pa WHERE class IN (SELECT DISTINCT label FROM order_pred_multi))
SELECT 'Accuracy' AS metric, CAST({R(f"100.0 * {_sdiv('c', 'n')}", 3)} AS DOUBLE) AS value FROM agg
UNION ALL SELECT 'Precision', {R('100.0 * prec', 3)} FROM agg
UNION ALL SELECT 'F1', {R('100.0 * f1', 3)} FROM agg
UNION ALL SELECT 'Recall', {R('100.0 * rec', 3)} FROM agg
UNION ALL SELECT 'Specificity', {R('100.0 * spec', 3)} FROM agg
UNION ALL SELECT 'Auc', {R('auc', 3)} FROM au
UNION ALL SELECT 'MCC', {R(_sdiv('c * n - spt', 'sqrt((n * n - sp2) * (n * n - st2))'), 3)} FROM agg) q"""


@query("ev_metrics_multiclass", "EV1,EV2,EV3,EV4,EV5,EV6,EV8,EV9,EV20",
       with_views(_MULTI_SQL, "order_pred_multi"))
def ev_metrics_multiclass(v):
    return M.classification_metrics(v.order_pred_multi, probability="probability", multiclass=True)


_REG_SQL = f"""
SELECT * FROM (WITH a AS (
  SELECT corr(label, prediction) AS r, avg((label - prediction) * (label - prediction)) AS mse,
         avg(abs(label - prediction)) AS mae,
         avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16)) AS mape,
         sum((label - prediction) * (label - prediction)) AS ssres, var_pop(label) * COUNT(*) AS sstot
  FROM order_pred_reg)
SELECT 'Pearson Correlation Coefficient' AS metric, CAST({R('r * 100.0', 3)} AS DOUBLE) AS value FROM a
UNION ALL SELECT 'Coefficient of Determination',
  {R('CASE WHEN sstot = 0 THEN (CASE WHEN ssres = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - ssres / sstot END', 3)} FROM a
UNION ALL SELECT 'Mean Absolute Error', {R('mae', 3)} FROM a
UNION ALL SELECT 'Mean Squared Error', {R('mse', 3)} FROM a
UNION ALL SELECT 'Root Mean Squared Error', {R('sqrt(mse)', 3)} FROM a
UNION ALL SELECT 'Mean Absolute Percentage Error', {R('mape', 3)} FROM a) q"""


@query("ev_metrics_regression", "EV10,EV11,EV12,EV13,EV14,EV15,EV20",
       with_views(_REG_SQL, "order_pred_reg"))
def ev_metrics_regression(v):
    return M.regression_metrics(v.order_pred_reg)


@query("ev_pearson_p_value", "EV15")
def ev_pearson_p_value(v):
    return M.pearson_p_value(v.order_pred_reg)


@query("ev_auc_probability", "EV8", with_views(f"""
SELECT {R('SUM(pos * (negcum - neg + neg / 2.0)) / (SUM(pos) * SUM(neg))')} AS auc FROM (
  SELECT pos, cnt - pos AS neg,
         SUM(cnt - pos) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS negcum
  FROM (SELECT probability AS score, CAST(SUM(label) AS DOUBLE) AS pos, CAST(COUNT(*) AS DOUBLE) AS cnt
        FROM order_pred GROUP BY 1) d) r""", "order_pred"))
def ev_auc_probability(v):
    return M.auc_ovr(v.order_pred, "label", "probability").select(rnd("auc").alias("auc"))


def _roc_sql(score: str) -> str:
    return f"""
SELECT threshold, {R('fp / nn')} AS fpr, {R('tp / np')} AS tpr FROM (
  SELECT threshold,
         SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
         SUM(cnt - pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
         SUM(pos) OVER () AS np, SUM(cnt - pos) OVER () AS nn
  FROM (SELECT CAST({score} AS DOUBLE) AS threshold, CAST(SUM(label) AS DOUBLE) AS pos,
               CAST(COUNT(*) AS DOUBLE) AS cnt FROM order_pred GROUP BY 1) d) r"""


@query("ev_roc_curve", "EV16", with_views(_roc_sql("probability"), "order_pred"))
def ev_roc_curve(v):
    return M.roc_points(v.order_pred, "label", "probability")


@query("ev_roc_rounded", "EV17", with_views(_roc_sql("floor(probability + 0.5)"), "order_pred"))
def ev_roc_rounded(v):
    df = v.order_pred.withColumn("rounded", F.floor(F.col("probability") + 0.5).cast("double"))
    return M.roc_points(df, "label", "rounded")


@query("ev_roc_multiclass", "EV16", with_views(f"""
SELECT class, threshold, {R('fp / nn')} AS fpr, {R('tp / np')} AS tpr FROM (
  SELECT class, threshold,
         SUM(pos) OVER (PARTITION BY class ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
         SUM(cnt - pos) OVER (PARTITION BY class ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
         SUM(pos) OVER (PARTITION BY class) AS np, SUM(cnt - pos) OVER (PARTITION BY class) AS nn
  FROM (SELECT class, score AS threshold, CAST(SUM(CASE WHEN label = class THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
               CAST(COUNT(*) AS DOUBLE) AS cnt FROM (
          SELECT label, 0 AS class, p0 AS score FROM order_pred_multi
          UNION ALL SELECT label, 1, p1 FROM order_pred_multi
          UNION ALL SELECT label, 2, p2 FROM order_pred_multi) l GROUP BY 1, 2) d) r""",
    "order_pred_multi"))
def ev_roc_multiclass(v):
    # each class's ROC uses its own probability column
    long = v.order_pred_multi.select("label", F.posexplode("probability").alias("class", "score"))
    long = long.withColumn("is_pos", F.when(F.col("label") == F.col("class"), 1).otherwise(0))
    return M.roc_points(long, "is_pos", "score", class_col="class")


@query("ev_class_histogram", "EV18", with_views("""
SELECT CAST(b.range AS INTEGER) AS bin, CAST(COALESCE(c.n_class0, 0) AS BIGINT) AS n_class0,
       CAST(COALESCE(c.n_class1, 0) AS BIGINT) AS n_class1
FROM range(10) b LEFT JOIN (
  SELECT CAST(least(floor(probability * 10.0), 9) AS INTEGER) AS bin,
         SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n_class0,
         SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n_class1
  FROM order_pred GROUP BY 1) c ON CAST(b.range AS INTEGER) = c.bin""", "order_pred"))
def ev_class_histogram(v):
    return M.class_probability_histogram(v.order_pred)


@query("ev_prediction_density", "EV19", with_views("""
SELECT CAST(floor(prediction / 50000.0) AS BIGINT) AS pred_bin,
       CAST(floor(label / 50000.0) AS BIGINT) AS true_bin, COUNT(*) AS n
FROM order_pred_reg GROUP BY 1, 2""", "order_pred_reg"))
def ev_prediction_density(v):
    return M.prediction_density(v.order_pred_reg)
