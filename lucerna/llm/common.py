"""Shared helpers of the corpus operators: tables, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.session import checkpoint_dir


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (the folder may be remote)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table under the shared checkpoint folder, read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recompute) and
    lets several later jobs share one expensive pass.  The folder is the one the
    cluster names in ``spark.checkpoint.dir``.  While the job runs, Python workers
    get batches of BATCH_ROWS rows, since rows hold whole texts.  Its shuffle files
    go as soon as the table is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    during = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
              "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fresh_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores appended until no column is called so (whatever the case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding about ``limit`` bytes of ``column`` each.

    A row is never cut: one text longer than the limit is a range of its own.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    Alternating large-star / small-star contraction.  Each round is two grouped
    minima and two joins on distributed tables, written to the shared folder, and
    the number of rounds grows with the logarithm of the longest chain.  A star
    centre with very many neighbours meets partial minima before the shuffle and
    a join whose large side AQE splits, never one task.  The root of a component
    is its smallest node; nodes without an edge are not listed.
    """
    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct(), name)
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = saved(small, name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
