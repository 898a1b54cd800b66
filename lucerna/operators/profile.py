"""PR1-PR6: dataset profiling as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd, with_scalars
from lucerna.functions.ranking import exact_quantiles


def unpivot(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (id..., feature, value) with values as DOUBLE."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*id_cols, F.explode(arr).alias("_kv")).select(*id_cols, f"_kv.{name}", f"_kv.{value}")


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR1: Pearson correlation of every ordered column pair, one aggregate pass.

    Output ``feature_a, feature_b, corr`` (diagonal = 1).
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                   for i, (a, b) in enumerate(pairs)])
    structs = []
    for i, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                rnd(F.col(f"{i}")).alias("corr")))
        structs.append(F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"),
                                rnd(F.col(f"{i}")).alias("corr")))
    for c in cols:
        structs.append(F.struct(F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"),
                                F.lit(1.0).alias("corr")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def top_correlated_pairs(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """PR2: upper-triangle pairs ranked by |corr| desc (ties by column order), first k."""
    cols = list(cols)
    pos = {c: i for i, c in enumerate(cols)}
    long = correlation_long(df, cols)
    pa = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    upper = long.where(pa[F.col("feature_a")] < pa[F.col("feature_b")])
    w = Window.orderBy(F.abs("corr").desc(), pa[F.col("feature_a")], pa[F.col("feature_b")])
    # at most d(d-1)/2 rows: a global Window over this table is tiny
    return (upper.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k))


def box_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR3: min / q1 / median / q3 / max per column (exact, linear interpolation)."""
    long = unpivot(df, [], cols)
    q = exact_quantiles(long, "value", ["feature"], [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return (q.groupBy("feature").pivot("p", list(names)).agg(F.first("q"))
            .select("feature", *[rnd(F.col(f"`{p}`")).alias(n) for p, n in names.items()]))


def trend_lines(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """PR4: least-squares line of the target on each feature."""
    long = unpivot(df, [target], cols)
    y = F.col(target).cast("double")
    return long.groupBy("feature").agg(rnd(F.regr_slope(y, F.col("value"))).alias("slope"),
                                       rnd(F.regr_intercept(y, F.col("value"))).alias("intercept"))


def class_balance(df: DataFrame, label: str = "label", split_col: str | None = "split") -> DataFrame:
    """PR5: rows and percentage (2 decimals) per class, per split."""
    g = [split_col] if split_col else []
    counts = df.groupBy(*g, label).agg(F.count(F.lit(1)).alias("n"))
    # one row per (split, class): the split total is a window over this tiny table
    j = counts.withColumn("_t", F.sum("n").over(Window.partitionBy(*g)))
    return j.select(*g, label, "n", rnd(100.0 * F.col("n") / F.col("_t"), 2).alias("pct"))


def distinct_targets(df: DataFrame, label: str = "label", split_col: str = "split") -> DataFrame:
    """PR5 (regression): number of distinct target values per split."""
    return df.groupBy(split_col).agg(F.countDistinct(label).alias("n_distinct"))


def feature_target_density(df: DataFrame, feature: str, label: str = "label",
                           n_bins: int = 20) -> DataFrame:
    """PR6: (first feature, target) pairs as a 2-D density: equal-width bins x class."""
    x = F.col(feature).cast("double")
    mm = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width == 0, 0).otherwise(
        F.least(F.floor((x - F.col("_mn")) / width * n_bins), F.lit(n_bins - 1))).cast("int")
    return (with_scalars(df, mm)  # one-row statistics as literals
            .groupBy(b.alias("bin"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
