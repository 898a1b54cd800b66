"""ML5 for regression: a one-hidden-layer ReLU network trained with full-batch Adam.

Spark ML offers MLP classification only.  Each epoch is one distributed pass:
``mapInPandas`` computes squared-error gradient sums per partition with the
current (broadcast) weights, the per-partition vectors (one per partition,
bounded by the parameter count) are summed on the driver and an Adam step is
taken there.  Prediction is written as column expressions, so scoring runs in
generated code without Python.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.local_fit import mlp_partition_gradients


def fit_mlp_regressor(df: DataFrame, feature_cols: Sequence[str], label: str = "label",
                      hidden: int = 16, epochs: int = 80, lr: float = 0.01, seed: int = 2020) -> dict:
    """Fit on (features, label); the target is standardised inside and restored in
    :func:`mlp_predict`.  Returns the weights and the loss history (ML22)."""
    cols = list(feature_cols)
    n_in = len(cols)
    st = df.agg(F.avg(F.col(label).cast("double")).alias("m"), F.stddev_pop(F.col(label).cast("double")).alias("s")).first()
    y_mean, y_sd = st["m"], (st["s"] or 1.0)
    data = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                     ((F.col(label).cast("double") - y_mean) / y_sd).alias("y")).persist()
    rng = random.Random(seed)
    scale = math.sqrt(2.0 / n_in)
    w = ([rng.gauss(0, scale) for _ in range(n_in * hidden)] + [0.0] * hidden
         + [rng.gauss(0, math.sqrt(1.0 / hidden)) for _ in range(hidden)] + [0.0])
    m_t, v_t = [0.0] * len(w), [0.0] * len(w)
    b1, b2, eps = 0.9, 0.999, 1e-8
    history = []
    for t in range(1, epochs + 1):
        cur = list(w)
        rows = data.mapInPandas(lambda it, cur=cur: mlp_partition_gradients(it, cur, n_in, hidden),
                                "grad array<double>, loss double, n long").collect()
        n = sum(r["n"] for r in rows) or 1
        grad = [0.0] * len(w)
        for r in rows:
            for k, gk in enumerate(r["grad"]):
                grad[k] += gk
        grad = [2.0 * gk / n for gk in grad]
        history.append(sum(r["loss"] for r in rows) / n)
        for k in range(len(w)):
            m_t[k] = b1 * m_t[k] + (1 - b1) * grad[k]
            v_t[k] = b2 * v_t[k] + (1 - b2) * grad[k] ** 2
            mh, vh = m_t[k] / (1 - b1 ** t), v_t[k] / (1 - b2 ** t)
            w[k] -= lr * mh / (math.sqrt(vh) + eps)
    data.unpersist()
    return {"features": cols, "hidden": hidden, "weights": w, "y_mean": y_mean, "y_sd": y_sd,
            "history": history}


def _output(model: dict) -> Column:
    cols, h, w = model["features"], model["hidden"], model["weights"]
    n_in = len(cols)
    b1_off, w2_off = n_in * h, n_in * h + h
    out = F.lit(w[w2_off + h])
    for j in range(h):
        z = F.lit(w[b1_off + j])
        for i, c in enumerate(cols):
            z = z + F.lit(w[j * n_in + i]) * F.col(c).cast("double")
        out = out + F.lit(w[w2_off + j]) * F.greatest(z, F.lit(0.0))
    return out * F.lit(model["y_sd"]) + F.lit(model["y_mean"])


def mlp_predict(model: dict, df: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns], _output(model).alias("prediction"))
