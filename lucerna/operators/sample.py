"""SP1, BA1-BA6: exact seeded split and class balancing.

All random choices are H1 hashes of (id, seed), so a lost executor recomputes
the same rows.  Ranks come from H2 (bucketed, no single-task Window).  Class
counts -- one number per class -- are the only values taken to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.exprs import with_scalars
from lucerna.functions.ranking import row_number_by_hash

SPLIT_SEED = 2020
BALANCE_SEED = 2020


def train_test_split(df: DataFrame, id_col: str = "id", train_size: float = 0.8,
                     seed=SPLIT_SEED, split_col: str = "split") -> DataFrame:
    """SP1: exact-size seeded split; the first floor(n * train) rows in hash order train."""
    if not 0.5 <= train_size <= 0.9:
        raise ValueError("train share must lie between 0.5 and 0.9")
    n = df.count()
    n_train = math.floor(n * train_size)
    ranked = row_number_by_hash(df, id_col, seed, "_rn")
    return (ranked.withColumn(split_col, F.when(F.col("_rn") <= n_train, "train").otherwise("test"))
            .drop("_rn"))


def class_counts(df: DataFrame, label: str = "label") -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def _replicate(df: DataFrame, copies_col: str, out_col: str, chunk: int = 4096) -> DataFrame:
    """Emit each row ``copies`` times with index 0..copies-1 in ``out_col``.

    Rows that need many copies are first split into chunks and re-spread over
    the cluster, so no single task generates an unbounded number of rows.
    """
    c = F.col(copies_col)
    n_chunks = F.greatest(F.ceil(c / F.lit(chunk)), F.lit(0)).cast("int")
    outer = (df.where(c > 0)
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
             .repartition("_chunk", *[x for x in df.columns[:1]]))
    lo = F.col("_chunk") * chunk
    hi = F.least(lo + chunk, c) - 1
    return outer.withColumn(out_col, F.explode(F.sequence(lo, hi))).drop("_chunk")


def random_over_sample(df: DataFrame, label: str = "label", id_col: str = "id",
                       seed=BALANCE_SEED, id_offset: int = 0) -> DataFrame:
    """BA1 ROS: every class re-sampled with replacement up to the majority count.

    Class c with n_c rows gets m_c = n_max - n_c added rows: floor(m_c / n_c)
    copies of every row plus the first (m_c mod n_c) rows in seeded hash
    order.  Added rows get negative ids -1, -2, ... (BA6) ordered by
    (class, copy, rank) and ``synthetic = true``.
    """
    counts = class_counts(df, label)
    if not counts:
        return df.withColumn("synthetic", F.lit(False))
    n_max = max(counts.values())
    offsets, acc = {}, id_offset
    for c in sorted(counts):
        offsets[c] = acc
        acc += n_max - counts[c]
    info = df.sparkSession.createDataFrame(
        [(c, counts[c], n_max - counts[c], offsets[c]) for c in counts],
        f"{label} {df.schema[label].dataType.simpleString()}, _nc long, _m long, _off long")
    ranked = row_number_by_hash(df, id_col, seed, "_rn", partition_cols=[label])
    # number of classes rows: a proven-small broadcast
    r = ranked.join(F.broadcast(info), label)
    full = F.floor(F.col("_m") / F.col("_nc"))
    rem = F.col("_m") - full * F.col("_nc")
    copies = full + F.when(F.col("_rn") <= rem, 1).otherwise(0)
    extra = _replicate(r.withColumn("_copies", copies), "_copies", "_copy")
    k = F.col("_off") + F.col("_copy") * F.col("_nc") + F.col("_rn") - 1
    added = (extra.withColumn(id_col, (-(k + 1)).cast(df.schema[id_col].dataType))
             .withColumn("synthetic", F.lit(True)).select(*df.columns, "synthetic"))
    return df.withColumn("synthetic", F.lit(False)).unionByName(added)


def random_under_sample(df: DataFrame, label: str = "label", id_col: str = "id",
                        seed=BALANCE_SEED) -> DataFrame:
    """BA2 RUS: every class cut to the minority count (first rows in seeded hash order)."""
    counts = class_counts(df, label)
    n_min = min(counts.values()) if counts else 0
    ranked = row_number_by_hash(df, id_col, seed, "_rn", partition_cols=[label])
    return ranked.where(F.col("_rn") <= n_min).drop("_rn")


def class_weights(df: DataFrame, label: str = "label", weight_col: str = "weight",
                  applies: bool = True) -> DataFrame:
    """BA5 PEN: weight n / (k * n_c) per row (1.0 when the model takes no weights)."""
    if not applies:
        return df.withColumn(weight_col, F.lit(1.0))
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # one row per class: totals are a window over this tiny table
    allc = Window.partitionBy()
    w = per.select(label, (F.sum("_nc").over(allc) / (F.count(F.lit(1)).over(allc) * F.col("_nc")))
                   .alias(weight_col))
    # one row per class: small, broadcast
    return df.join(F.broadcast(w), label)


def balance(df: DataFrame, methods: Sequence[str], label: str = "label", id_col: str = "id",
            feature_cols: Sequence[str] | None = None, seed=BALANCE_SEED) -> DataFrame:
    """BA6: methods applied in the order given (ROS, RUS, SMOTE, ADASYN, PEN).

    Rows that a method adds keep their ``synthetic`` flag through the later ones,
    whose ids go on below the lowest synthetic id so far.
    """
    def grown(old: DataFrame, fn, *args) -> DataFrame:
        flagged = old if "synthetic" in old.columns else old.withColumn("synthetic", F.lit(False))
        low = (old.where("synthetic").agg(F.min(F.col(id_col).cast("long"))).first()[0]
               if "synthetic" in old.columns else None)
        new = fn(old.drop("synthetic"), *args, seed=seed, id_offset=-low if low is not None else 0)
        return flagged.unionByName(new.where("synthetic"), allowMissingColumns=True)

    out = df
    for m in methods:
        if m == "ROS":
            out = grown(out, random_over_sample, label, id_col)
        elif m == "RUS":
            out = random_under_sample(out, label, id_col, seed)
        elif m == "PEN":
            out = class_weights(out, label)
        elif m in ("SMOTE", "ADASYN"):
            from lucerna.operators.neighbours import adasyn, smote
            cols = feature_cols or [c for c in out.columns if c not in (id_col, label, "synthetic")]
            fn = smote if m == "SMOTE" else adasyn
            out = grown(out, lambda df, *a, fn=fn, cols=cols, **k: fn(df, cols, *a, **k), label, id_col)
        else:
            raise ValueError(f"unknown balancing method {m}")
    return out


