"""CO1-CO16: consensus of explanations across methods (and models).

Input: the long attribution table ``model, method, sample_id (NULL for
global methods), feature, attribution, probability``.  A "file" of the
reference is one (model, method, sample_id) group; its rows are one per
feature, so every per-file Window is bounded by the feature count.  All
models are processed in one job with ``model`` as an extra grouping key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE_KEYS = ["model", "method", "sample_id"]
TOP = 10
CAPPED_RANK = 11


def _by(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys)


def _by_file(df: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``add``, which works inside each file, on local and global files apart.

    Local rows made from a table that is placed by the sample stay where they are:
    the union of both kinds hides that placement and would shuffle every row.
    """
    return add(df.where(~_is_global())).unionByName(add(df.where(_is_global())))


def with_ranking(attr: DataFrame) -> DataFrame:
    """CO1: ``ranking`` = position by signed attribution desc inside each file
    (ties by feature name).
    """
    w = Window.partitionBy(*FILE_KEYS).orderBy(F.col("attribution").desc(), F.col("feature"))
    return _by_file(attr, lambda part: part.withColumn("ranking", F.row_number().over(w).cast("long")))


def _is_global():
    return F.col("sample_id").isNull()


def average_mean(attr: DataFrame) -> DataFrame:
    """CO2 AM: mean attribution per (model, feature)."""
    return attr.groupBy("model", "feature").agg(F.avg("attribution").alias("attribution"))


def _minmax(attr: DataFrame, keys: Sequence[str]) -> DataFrame:
    st = attr.groupBy(*keys).agg(F.min("attribution").alias("_mn"), F.max("attribution").alias("_mx"))
    rng = F.col("_mx") - F.col("_mn")
    return (attr.join(F.broadcast(st), list(keys))  # one row per model / kind: a join by model would fill one task a model
            .withColumn("_x", F.when(rng == 0, 0.0).otherwise((F.col("attribution") - F.col("_mn")) / rng)))


def harmonic_mean(attr: DataFrame) -> DataFrame:
    """CO3 HM: min-max to [0, 1] over the model's rows, harmonic mean per feature
    (0 when any scaled value is 0)."""
    x = _minmax(attr, ["model"])
    return x.groupBy("model", "feature").agg(
        F.when(F.min("_x") == 0, 0.0).otherwise(F.count(F.lit(1)) / F.sum(F.try_divide(F.lit(1.0), F.col("_x"))))
        .alias("attribution"))


def geometric_mean(attr: DataFrame) -> DataFrame:
    """CO4 GM: min-max, geometric mean per feature (0 when any value is 0)."""
    x = _minmax(attr, ["model"])
    return x.groupBy("model", "feature").agg(
        F.when(F.min("_x") == 0, 0.0).otherwise(F.exp(F.avg(F.log(F.greatest("_x", F.lit(1e-300))))))
        .alias("attribution"))


def voting(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """CO5 VF: number of files in which a feature ranks within the top ``top``."""
    return ranked.groupBy("model", "feature").agg(
        F.sum(F.when(F.col("ranking") <= top, 1).otherwise(0)).cast("long").alias("votes"))


def average_rank(ranked: DataFrame) -> DataFrame:
    """CO6 AR: mean rank per feature (ascending is best)."""
    return ranked.groupBy("model", "feature").agg(F.avg("ranking").alias("ranking"))


def custom(attr: DataFrame, quality: DataFrame, task: str = "classification") -> DataFrame:
    """CO7 CU: alpha-weighted signed min-max scores summed per feature.

    alpha = 4A^2 - 4A + 1 (A = AUC) or R^2.  Global and local rows are
    scaled separately (signed: x * sign(a)); local rows are also divided by
    the model's number of local rows and multiplied by ``probability``.
    Models without a quality value are skipped (CO8).

    The score is linear in sign(a) * a * p and sign(a) * p (p = 1 for global
    rows), so one grouped pass over the rows gives everything: their sums, the
    extremes and the counts, combined on the small (model, kind, feature) table.
    """
    q = quality.select("model", F.col("metric").alias("_m"))
    alpha = (4.0 * F.col("_m") * F.col("_m") - 4.0 * F.col("_m") + 1.0) if task == "classification" else F.col("_m")
    a = F.col("attribution")
    share = F.when(_is_global(), 1.0).otherwise(F.col("probability"))
    sp = F.when(a < 0, -share).when(a.isNotNull(), share)
    per = (attr.groupBy("model", F.when(_is_global(), "g").otherwise("l").alias("_kind"), "feature")
           .agg(F.sum(sp * a).alias("_sap"), F.sum(sp).alias("_sp"), F.min(a).alias("_mn"),
                F.max(a).alias("_mx"), F.count(F.lit(1)).alias("_n")))
    file = Window.partitionBy("model", "_kind")   # one row per feature
    mn, n = F.min("_mn").over(file), F.sum("_n").over(file)
    per = per.withColumn("_lo", mn).withColumn("_rng", F.max("_mx").over(file) - mn).withColumn("_rows", n)
    scaled = F.when(F.col("_rng") == 0, F.col("_sp") * 0.0).otherwise(
        (F.col("_sap") - F.col("_lo") * F.col("_sp")) / F.col("_rng"))
    s = per.join(q, "model").withColumn(
        "_s", scaled * alpha / F.when(F.col("_kind") == "l", F.col("_rows")).otherwise(1))
    return s.groupBy("model", "feature").agg(F.sum("_s").alias("attribution"))


def select_models(quality: DataFrame, cutoff: float = 0.75, higher_is_better: bool = True) -> DataFrame:
    """CO9: models whose metric passes the cutoff (reversed for error metrics)."""
    cond = F.col("metric") >= cutoff if higher_is_better else F.col("metric") <= cutoff
    return quality.where(cond)


def weighted_capped(ranked: DataFrame, quality: DataFrame) -> DataFrame:
    """CO10: attribution x model metric, rank capped at 11, 'Sum ...' rows dropped."""
    return (ranked.where(~F.col("feature").startswith("Sum"))
            .join(F.broadcast(quality.select("model", "metric")), "model")  # one row per model
            .select(*FILE_KEYS, "feature", (F.col("attribution") * F.col("metric")).alias("attribution"),
                    F.least(F.col("ranking"), F.lit(CAPPED_RANK)).alias("ranking")))


def complete_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """CO11: every file gets every feature; absent ones attribution 0, rank 11.

    Done with a pivot over the (bounded) feature list and an unpivot, not a
    join of all files with all features.
    """
    feats = list(features)
    wide = _by_file(df, lambda part: part.groupBy(*FILE_KEYS).pivot("feature", feats).agg(
        F.first(F.struct("attribution", "ranking"))))
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             F.coalesce(F.col(f"`{f}`.attribution"), F.lit(0.0)).alias("attribution"),
                             F.coalesce(F.col(f"`{f}`.ranking"), F.lit(CAPPED_RANK).cast("long")).alias("ranking"))
                    for f in feats])
    return wide.select(*FILE_KEYS, F.explode(arr).alias("s")).select(*FILE_KEYS, "s.*")


def by_method(df: DataFrame) -> DataFrame:
    """CO12: per (method, feature): mean / std (0 if undefined) of |attribution| and of rank."""
    return df.groupBy("method", "feature").agg(
        F.avg(F.abs("attribution")).alias("attribution"),
        F.coalesce(F.stddev_samp(F.abs("attribution")), F.lit(0.0)).alias("attribution_std"),
        F.avg("ranking").alias("ranking"),
        F.coalesce(F.stddev_samp("ranking"), F.lit(0.0)).alias("ranking_std"))


def ranks_by_sample(ranked: DataFrame) -> DataFrame:
    """CO13: per (model, sample): features ranked by every local method (the
    inner join of the methods' ranks), mean rank rounded to 2 decimals.

    A sample holds methods x features rows; its methods are counted by a window.
    """
    sample = Window.partitionBy("model", "sample_id")
    loc = ranked.where(~_is_global()).withColumn("_k", F.size(F.collect_set("method").over(sample)))
    per = loc.groupBy("model", "sample_id", "feature").agg(
        F.count(F.lit(1)).alias("_c"), F.avg("ranking").alias("_r"), F.first("_k").alias("_k"))
    from lucerna.functions.exprs import rnd
    return (per.where(F.col("_c") == F.col("_k"))
            .select("model", "sample_id", "feature", rnd("_r", 2).alias("ranking")))


def global_rank(ranked: DataFrame) -> DataFrame:
    """CO14: per (model, feature): mean and std (0 if undefined) of the rank over
    samples and local methods."""
    loc = ranked.where(~_is_global())
    return loc.groupBy("model", "feature").agg(
        F.avg("ranking").alias("ranking"), F.coalesce(F.stddev_samp("ranking"), F.lit(0.0)).alias("std"))


def scale_max_abs(attr: DataFrame) -> DataFrame:
    """CO16: attribution / max |attribution| inside each file."""
    m = F.max(F.abs("attribution")).over(_by(FILE_KEYS))
    return _by_file(attr, lambda part: part.withColumn("attribution", F.when(m == 0, 0.0).otherwise(F.col("attribution") / m)))
