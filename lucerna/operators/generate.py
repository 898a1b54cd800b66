"""GE1-GE4: synthetic tables, keyed by rows of an existing table.

Every value is an H1 uniform of (row key, seed, column), so a generated
table is a pure function of its key table -- recomputable after executor
loss and checkable in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.hashing import hash_uniform

GEN_SEED = 42


def rule_dataset(keys: DataFrame, key_col: str, n_features: int, positive_share: float,
                 rules: dict[int, tuple[float | None, float | None]], seed=GEN_SEED) -> DataFrame:
    """GE1: one row per key, ``x0..x{n-1}`` uniform in [0, 1), ``label``.

    label = 1 with probability ``positive_share``.  A ruled feature i with
    bounds (lo, hi) lies inside [lo, hi] for class 1 and outside for class 0
    (below or above with equal chance when both sides exist; None = open).
    """
    k = F.col(key_col)
    label = (hash_uniform(k, seed, "label") < positive_share).cast("int")
    cols = []
    for i in range(n_features):
        u = hash_uniform(k, seed, f"x{i}")
        if i not in rules:
            cols.append(u.alias(f"x{i}"))
            continue
        lo, hi = rules[i]
        lo_v, hi_v = (0.0 if lo is None else lo), (1.0 if hi is None else hi)
        inside = F.lit(lo_v) + F.lit(hi_v - lo_v) * u
        below = u * F.lit(lo_v)
        above = F.lit(hi_v) + F.lit(1.0 - hi_v) * u
        if lo is not None and hi is not None:
            side = hash_uniform(k, seed, f"side{i}") < 0.5
            outside = F.when(side, below).otherwise(above)
        elif lo is not None:
            outside = below
        else:
            outside = above
        cols.append(F.when(label == 1, inside).otherwise(outside).alias(f"x{i}"))
    return keys.select(k.alias("id"), *cols, label.alias("label"))


def class_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """GE2: positives and their share."""
    return df.agg(F.sum(F.col(label)).cast("long").alias("positives"),
                  (F.sum(F.col(label)) / F.count(F.lit(1))).alias("ratio"))


def random_like(df: DataFrame, key_col: str, cols: Sequence[str], seed=GEN_SEED) -> DataFrame:
    """GE3: per column uniform between the column's min and max -- integers when
    both ends are integral, the constant when they are equal."""
    row = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
                                               F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]).first()
    out = []
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        u = hash_uniform(key_col, seed, c)
        if lo == hi:
            v = F.lit(lo)
        elif float(lo).is_integer() and float(hi).is_integer():
            v = F.floor(F.lit(lo) + F.lit(hi - lo + 1.0) * u).cast("double")
        else:
            v = F.lit(lo) + F.lit(hi - lo) * u
        out.append(v.alias(c))
    return df.select(F.col(key_col).alias("id"), *out)


def one_hot_groups(df: DataFrame, key_col: str, groups: dict[str, Sequence[str]], seed=GEN_SEED) -> DataFrame:
    """GE4: for each group of one-hot columns exactly one column is 1 per row."""
    out = [F.col(key_col)]
    for g, members in groups.items():
        members = list(members)
        pick = F.floor(hash_uniform(key_col, seed, g) * len(members)).cast("int")
        out += [F.when(pick == i, 1).otherwise(0).alias(m) for i, m in enumerate(members)]
    return df.select(*out)
