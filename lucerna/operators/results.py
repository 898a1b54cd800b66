"""RS1-RS7, IO5, IO6: result tables over the long metrics table ``run, model, metric, value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_by_run(metrics: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """RS1: rows = metrics, one column per run (sorted)."""
    runs = sorted(runs) if runs is not None else None
    return metrics.groupBy("metric").pivot("run", runs).agg(F.first("value"))


def parameter_by_run(params: DataFrame) -> DataFrame:
    """RS2: rows = parameter names (union over runs), one column per run, '-' if absent.

    ``params`` is long: run, param, value (text)."""
    runs = sorted(r[0] for r in params.select("run").distinct().collect())
    wide = params.groupBy("param").pivot("run", runs).agg(F.first("value"))
    return wide.fillna("-", subset=runs)


def run_names(metrics: DataFrame) -> DataFrame:
    """RS1 naming: the k-th run of a model is NAME (k = 1) or NAME_k."""
    from pyspark.sql import Window
    runs = metrics.select("model", "run").distinct()
    w = Window.partitionBy("model").orderBy("run")
    k = F.row_number().over(w)
    return runs.select("model", "run", F.when(k == 1, F.col("model"))
                       .otherwise(F.concat(F.col("model"), F.lit("_"), k.cast("string"))).alias("name"))


def comparison_table(metrics: DataFrame, metric_names: Sequence[str]) -> DataFrame:
    """RS4: one row per model, one column per short metric name; a regression
    Pearson text ``r/p`` is split into two numbers first."""
    m = metrics
    if "metric" in m.columns and m.schema["value"].dataType.typeName() == "string":
        parts = F.split(F.col("value"), "/")
        pear = m.where(F.col("metric") == "Pearson Correlation Coefficient")
        m = (m.where(F.col("metric") != "Pearson Correlation Coefficient")
             .select("model", "metric", F.col("value").cast("double").alias("value"))
             .unionByName(pear.select("model", F.lit("Pearson r").alias("metric"), parts[0].cast("double").alias("value")))
             .unionByName(pear.select("model", F.lit("Pearson p").alias("metric"), parts[1].cast("double").alias("value"))))
    return m.groupBy("model").pivot("metric", list(metric_names)).agg(F.first("value"))


def run_key(run_col: str = "run"):
    """RS5 key: the run name up to its first underscore."""
    return F.regexp_extract(F.col(run_col), r"^([^_]*)", 1)


def multi_run_summary(metrics: DataFrame, metric_names: Sequence[str]) -> DataFrame:
    """RS5: mean of each metric per run key (wide)."""
    return (metrics.withColumn("key", run_key()).groupBy("key")
            .pivot("metric", list(metric_names)).agg(F.avg("value")))


def with_mean_std(summary: DataFrame, cols: Sequence[str], key: str = "key") -> DataFrame:
    """RS6: append a ``Mean`` and a ``Std`` (sample) row over the numeric columns."""
    mean = summary.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("Mean").alias(key), *cols)
    std = summary.agg(*[F.stddev_samp(c).alias(c) for c in cols]).select(F.lit("Std").alias(key), *cols)
    return summary.select(key, *cols).unionByName(mean).unionByName(std)


def parse_timings(lines: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """RS7: ``key:seconds:position`` lines (first line of each timing file) ->
    stage, seconds (rounded to 2), position; ordered by position downstream."""
    parts = F.split(F.col("value"), ":")
    return lines.select(prefix_col, parts[0].alias("stage"),
                        F.round(parts[1].cast("double"), 2).alias("seconds"),
                        parts[2].cast("int").alias("position"))


def read_timings(spark, path_glob: str) -> DataFrame:
    """RS7 source: first line of every ``*_time.txt`` file, prefix from the file name."""
    df = spark.read.text(path_glob).select("value", F.col("_metadata.file_path").alias("_f"))
    first = df.groupBy("_f").agg(F.first("value").alias("value"))
    return parse_timings(first.select(F.regexp_extract("_f", r"([^/]*)_time\.txt$", 1).alias("prefix"), "value"))


def metrics_from_resume(spark, path_glob: str) -> DataFrame:
    """IO6: resume text files -> (model, metric, value).

    Lines after the one holding 'Analysis Data' that look like
    ``Name: number`` (words, digits and spaces allowed in the name -- the
    reference's pattern missed 'F1' and multi-word names; negative values are
    kept).  Model = file name up to the first underscore.
    """
    from pyspark.sql import Window
    df = spark.read.text(path_glob).select("value", F.col("_metadata.file_path").alias("_f"),
                                          F.monotonically_increasing_id().alias("_pos"))
    w = Window.partitionBy("_f").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_after", F.max(F.col("value").contains("Analysis Data").cast("int")).over(w))
    pat = r"^\s*([A-Za-z][A-Za-z0-9 ]*?):\s+(-?[0-9.]+)\s*$"
    m = flagged.where((F.col("_after") == 1) & F.col("value").rlike(pat))
    return m.select(F.regexp_extract("_f", r"([^/]*?)_[^/]*$", 1).alias("model"),
                    F.regexp_extract("value", pat, 1).alias("metric"),
                    F.regexp_extract("value", pat, 2).cast("double").alias("value"))


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """IO5 sink: metrics as JSON lines (one per model / metric)."""
    metrics.write.mode("overwrite").json(path)


def read_metrics_json(spark, path: str) -> DataFrame:
    """IO5 source: the JSON written by :func:`write_metrics_json`."""
    return spark.read.schema("run string, model string, metric string, value double").json(path)
