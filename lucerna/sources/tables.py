"""IO1 / IO2: reading tables and assigning column roles."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """IO1: read a table by extension (CSV with header, or Parquet).

    Pickled pandas frames are re-aimed to Parquet.  Any other extension is an
    error, as is a missing file (Spark raises on a missing path).
    """
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        opts = {"header": "true", "inferSchema": "true"}
        opts.update(csv_options)
        df = spark.read.options(**opts).csv(path)
    elif lower.endswith(".parquet") or lower.endswith(".pq"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    # NaN is normalised to NULL so every aggregate treats missing values alike.
    dbl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if dbl:
        df = df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in dbl else F.col(c)
                         for c in df.columns])
    return df


@dataclass(frozen=True)
class Roles:
    """Column roles of a modelling table (IO2)."""

    id_col: str
    target_col: str | None
    feature_cols: list[str] = field(default_factory=list)

    @staticmethod
    def positional(df: DataFrame, predicting: bool = False) -> "Roles":
        """First column = id, last = target, the rest = features.

        In predict mode there is no target and every non-id column is a
        feature (the reference drops the last feature name there; fixed).
        """
        cols = df.columns
        if predicting:
            return Roles(cols[0], None, cols[1:])
        return Roles(cols[0], cols[-1], cols[1:-1])


def role_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """IO2 as a table: rows, feature count and distinct target values."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(roles.feature_cols)).cast("long").alias("n_features")]
    if roles.target_col:
        aggs.append(F.countDistinct(F.col(roles.target_col)).cast("long").alias("n_classes"))
    return df.agg(*aggs)
