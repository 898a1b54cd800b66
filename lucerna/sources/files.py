"""IO3, IO4, IO7, IO8, IO10: file sources and sinks around a run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.local_fit import metrics_from_archive

# Fixed layout of attribution file names: <model>_<method>[_<sample>].csv
ATTRIBUTION_FILE = r"([^/_]+)_([^/_]+)(?:_([^/]+))?\.csv$"


def write_sorted_attributions(df: DataFrame, path: str, col: str | None = None) -> None:
    """IO3: order by |weight| or |mean| (whichever exists, else |attribution|) desc, write CSV.

    ``orderBy`` range-partitions, so the part files are globally ordered.
    """
    col = col or next((c for c in ("weight", "mean", "attribution") if c in df.columns), None)
    out = df.orderBy(F.abs(col).desc()) if col else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_predictions(scores: DataFrame, path: str) -> None:
    """IO4: the ``Sample ID, Predicted class, Probability`` table as CSV."""
    scores.select("Sample ID", "Predicted class", "Probability").write.mode("overwrite") \
        .option("header", "true").csv(path)


def read_archive_metrics(spark: SparkSession, path_glob: str) -> DataFrame:
    """IO7: metrics of every ``*_data.json`` inside ``*.tar.gz`` run archives.

    One archive is one row of ``binaryFile`` and is opened inside one task
    (mapInPandas); output ``key, model, metric, value`` with key = archive
    name up to the first underscore.  Confusion matrices and text values are
    skipped.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.tar.gz").load(path_glob).select("path", "content"))
    return files.mapInPandas(metrics_from_archive, "key string, model string, metric string, value double")


def read_attribution_files(spark: SparkSession, path_glob: str, pattern: str = ATTRIBUTION_FILE) -> DataFrame:
    """IO8: attribution CSVs with model, method and sample id taken from the file name."""
    df = spark.read.option("header", "true").option("inferSchema", "true").csv(path_glob)
    f = F.col("_metadata.file_path")
    sample = F.regexp_extract(f, pattern, 3)
    return df.select("*", F.regexp_extract(f, pattern, 1).alias("model"),
                     F.regexp_extract(f, pattern, 2).alias("method"),
                     F.when(sample == "", None).otherwise(sample).alias("sample_id"))


def save_state(path: str, split: DataFrame, model) -> None:
    """IO10: the split table (with its ``split`` column) and the fitted model,
    so explanations can run later."""
    split.write.mode("overwrite").parquet(os.path.join(path, "split"))
    model.write().overwrite().save(os.path.join(path, "model"))


def load_state(spark: SparkSession, path: str):
    """IO10: (split table, model) written by :func:`save_state`."""
    from pyspark.ml import PipelineModel
    return spark.read.parquet(os.path.join(path, "split")), PipelineModel.load(os.path.join(path, "model"))
