"""ML17 as a stream: score parquet files as they arrive with a fitted PipelineModel.

The reference scores a table with saved models in batch; the same plan runs
unchanged over ``readStream``: model.transform is a per-row map, so each
micro-batch is scored independently, and the file sink with a checkpoint
gives exactly-once output across restarts and lost executors.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lucerna.operators.models import probability_array
from lucerna.session import checkpoint_dir


def _score(model: PipelineModel, batch: DataFrame, task: str, id_col: str) -> DataFrame:
    out = model.transform(batch)
    if task == "classification" and "probability" in out.columns:
        p = probability_array(out)
        pmax = F.array_max(p)
        return out.select(F.col(id_col).alias("Sample ID"),
                          (F.array_position(p, pmax) - 1).cast("int").alias("Predicted class"),
                          pmax.alias("Probability"))
    if task == "classification":
        return out.select(F.col(id_col).alias("Sample ID"), F.col("prediction").cast("int").alias("Predicted class"),
                          F.lit(1.0).alias("Probability"))
    return out.select(F.col(id_col).alias("Sample ID"), F.lit(-1).alias("Predicted class"),
                      F.col("prediction").cast("double").alias("Probability"))


def scoring_query(spark: SparkSession, model: PipelineModel, src_dir: str, schema: StructType,
                  out_dir: str, checkpoint: str | None = None, task: str = "classification",
                  id_col: str = "id", once: bool = True, max_files_per_trigger: int = 64):
    """Start the streaming scoring query; returns the StreamingQuery."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "scoring-" + os.path.basename(out_dir.rstrip("/")))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(src_dir))
    scored = _score(model, stream, task, id_col)
    writer = (scored.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def score_stream(spark: SparkSession, model: PipelineModel, src_dir: str, schema: StructType,
                 out_dir: str, checkpoint: str | None = None, task: str = "classification",
                 id_col: str = "id", once: bool = True) -> DataFrame:
    """Run :func:`scoring_query` (``once``: all files available now) and read the output."""
    q = scoring_query(spark, model, src_dir, schema, out_dir, checkpoint, task, id_col, once)
    q.awaitTermination()
    return spark.read.parquet(out_dir)
