"""Entropy discretiser of LIME: per feature, the cuts of a classification tree of limited depth.

All features and all open intervals are split in one pass a level: rows collapse to
class counts per distinct (feature, value), exact running sums give the classes left
of every value, and the value with the largest information gain wins its
interval.  Only the winners reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.functions.ranking import exact_quantiles, running_sums, with_group_quantile_bucket
from lucerna.session import checkpoint_dir

DIGITS = 9  # gains are compared with so many decimals; of equal ones the smallest value is cut


def entropy(counts: Sequence[Column]) -> Column:
    """Entropy (bits) of class counts; 0 without rows."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0) for c in counts]
    return -sum(terms[1:], terms[0])


def long_values(df: DataFrame, feature_cols: Sequence[str], *others: str) -> DataFrame:
    """(others..., feature, value), one row per row and feature with a value."""
    return (df.select(*others, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                                   for c in feature_cols])).alias("s"))
            .select(*others, "s.*").where("value is not null"))


def interval_of(cuts: dict[str, list[float]], feature: Column, value: Column) -> Column:
    """Number of the feature's cuts below the value (a value on a cut lies left of it)."""
    out = F.lit(0)
    for c, found in cuts.items():
        if found:
            out = F.when(feature == c, F.size(F.filter(F.array(*[F.lit(x) for x in found]), lambda e: e < value))).otherwise(out)
    return out


def entropy_cuts(df: DataFrame, feature_cols: Sequence[str], label: str = "label", depth: int = 3) -> dict[str, list[float]]:
    """Cuts per feature, ascending: midpoints between the values that a tree of ``depth`` levels splits apart.

    A feature that no split gains on is cut at its median.  Null values and labels
    are left out; a feature without values has no cut.
    """
    checkpoint_dir(df.sparkSession)
    cols = list(feature_cols)
    rows = long_values(df.where(F.col(label).isNotNull()), cols, label)
    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    names = [f"n{i}" for i in range(len(classes))]
    counted = rows.groupBy("feature", "value").agg(
        *[F.sum(F.when(F.col(label) == F.lit(y), 1).otherwise(0)).alias(n) for y, n in zip(classes, names, strict=True)]).checkpoint()
    cuts: dict[str, list[float]] = {c: [] for c in cols}
    for _ in range(depth if len(classes) > 1 else 0):
        placed = counted.withColumn("node", interval_of(cuts, F.col("feature"), F.col("value")))
        totals = placed.groupBy("feature", "node").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
        mixed = totals.where(sum((F.when(F.col(f"t_{n}") > 0, 1).otherwise(0) for n in names[1:]),
                                 F.when(F.col(f"t_{names[0]}") > 0, 1).otherwise(0)) > 1)
        open_ = placed.join(mixed.select("feature", "node"), ["feature", "node"], "left_semi")
        keyed = with_group_quantile_bucket(open_, "value", ["feature", "node"])
        run = running_sums(keyed, ["value"], {f"l_{n}": F.col(n) for n in names}, ["feature", "node"]).join(mixed, ["feature", "node"])
        left, whole = [F.col(f"l_{n}") for n in names], [F.col(f"t_{n}") for n in names]
        right = [w - x for w, x in zip(whole, left, strict=True)]
        nl, nr = sum(left[1:], left[0]), sum(right[1:], right[0])
        gain = entropy(whole) - (nl * entropy(left) + nr * entropy(right)) / (nl + nr)
        best = (run.where(nr > 0).select("feature", "node", F.struct(rnd(gain, DIGITS).alias("gain"), (-F.col("value")).alias("minus")).alias("g"))
                .groupBy("feature", "node").agg(F.max("g").alias("g")).where("g.gain > 0")
                .select("feature", "node", (-F.col("g.minus")).alias("at")))
        after = (placed.join(best, ["feature", "node"]).where("value > at").groupBy("feature", "at").agg(F.min("value").alias("next")).collect())
        if not after:
            break
        for r in after:
            cuts[r["feature"]] = sorted({*cuts[r["feature"]], (r["at"] + r["next"]) / 2.0})
    plain = [c for c in cols if not cuts[c]]
    if plain:
        for r in exact_quantiles(rows.where(F.col("feature").isin(plain)).select("feature", "value"), "value", ["feature"], [0.5]).collect():
            cuts[r["feature"]] = [r["q"]]
    return cuts


def quartile_cuts(df: DataFrame, feature_cols: Sequence[str]) -> dict[str, list[float]]:
    """The distinct quartiles of each feature, ascending."""
    cuts: dict[str, set[float]] = {c: set() for c in feature_cols}
    for r in exact_quantiles(long_values(df, feature_cols), "value", ["feature"], [0.25, 0.5, 0.75]).collect():
        cuts[r["feature"]].add(r["q"])
    return {c: sorted(v) for c, v in cuts.items()}


def range_texts(feature: str, cuts: Sequence[float]) -> list[str]:
    """The texts of a feature's intervals."""
    t = [f"{v:.2f}" for v in cuts]
    if not t:
        return [feature]
    return [f"{feature} <= {t[0]}", *[f"{a} < {feature} <= {b}" for a, b in zip(t, t[1:])], f"{feature} > {t[-1]}"]
