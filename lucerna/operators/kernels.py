"""ML3: kernel feature maps as SQL, and support-vector regression on them.

A kernel machine over many rows becomes a linear one over a fixed number of
features: random Fourier features for the RBF kernel, and for polynomial and sigmoid
kernels the Nystroem map, kernel values against some landmark rows times the
inverse root of the landmarks' own kernel matrix.  :class:`KernelMap` is a pipeline
stage that maps Arrow batches by matrix products; the same maps are also offered as
SQL statements (higher-order functions over literal arrays), which need no Python
but take some hundred times as long.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNELS = ("rbf", "linear", "poly", "sigmoid")


def _numbers(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0.0D, (s, t) -> s + t)"


def _row(cols: Sequence[str]) -> str:
    return "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in cols) + ")"


def _columns(inner: str, names: list[str], scratch: str) -> str:
    return (f"SELECT * EXCEPT ({scratch}), " + ", ".join(f"_map[{i}] AS {n}" for i, n in enumerate(names)) + f" FROM ({inner})")


def fourier_draws(d: int, n_components: int, gamma: float, seed: int) -> list[tuple[list[float], float]]:
    """(w, b) of every random Fourier feature."""
    rng = random.Random(seed)
    return [([rng.gauss(0.0, math.sqrt(2.0 * gamma)) for _ in range(d)], rng.uniform(0.0, 2.0 * math.pi)) for _ in range(n_components)]


def fourier_statement(cols: Sequence[str], n_components: int, gamma: float, seed: int) -> tuple[str, list[str]]:
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2) as SQL.

    z_j(x) = sqrt(2 / D) cos(w_j . x + b_j), w ~ N(0, 2 gamma I), b ~ U(0, 2 pi)
    (Rahimi & Recht 2007), drawn once from ``seed``.
    """
    draws = [f"struct({_numbers(w)} AS w, {b!r}D AS b)" for w, b in fourier_draws(len(cols), n_components, gamma, seed)]
    names = [f"_rff_{j}" for j in range(n_components)]
    inner = (f"SELECT *, transform(array({', '.join(draws)}), r -> {math.sqrt(2.0 / n_components)!r}D * cos({_dot(_row(cols), 'r.w')} + r.b)) "
             "AS _map FROM __THIS__")
    return _columns(inner, names, "_map"), names


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, coef0: float, degree: int) -> np.ndarray:
    dot = gamma * (a @ b.T) + coef0
    return dot ** degree if kernel == "poly" else np.tanh(dot)


def landmarks(df: DataFrame, cols: Sequence[str], kernel: str, n_components: int, gamma: float, coef0: float,
              degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks of a Nystroem map and the inverse root of their own kernel matrix."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    found = (df.select(x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).distinct()
             .orderBy(F.xxhash64("x"), "x").limit(n_components).collect())
    if not found:
        raise ValueError("no row without a null to take landmarks from")
    marks = np.array([r["x"] for r in found], float)
    value, vector = np.linalg.eigh(kernel_matrix(marks, marks, kernel, gamma, coef0, degree))
    good = np.abs(value) > np.abs(value).max() * 1e-10
    return marks, vector[:, good] / np.sqrt(np.abs(value[good]))


def nystroem_statement(df: DataFrame, cols: Sequence[str], kernel: str, n_components: int = 100, gamma: float | None = None,
                       coef0: float = 0.0, degree: int = 3) -> tuple[str, list[str]]:
    """Nystroem map of a polynomial or sigmoid kernel as SQL.

    Landmarks are ``n_components`` distinct rows in hash order (all rows if there
    are fewer); only they reach the driver.  A sigmoid kernel need not be positive:
    the sign of its negative directions is dropped.
    """
    gamma = 1.0 / max(len(cols), 1) if gamma is None else gamma
    marks, root = landmarks(df, cols, kernel, n_components, gamma, coef0, degree)
    names = [f"_nys_{j}" for j in range(root.shape[1])]
    inside = f"{float(gamma)!r}D * {_dot(_row(cols), 'm')} + {float(coef0)!r}D"
    values = f"power({inside}, {int(degree)})" if kernel == "poly" else f"tanh({inside})"
    against = f"SELECT *, transform(array({', '.join(_numbers(m) for m in marks)}), m -> {values}) AS _against FROM __THIS__"
    inner = f"SELECT *, transform(array({', '.join(_numbers(c) for c in root.T)}), w -> {_dot('_against', 'w')}) AS _map FROM ({against})"
    return _columns(inner, names, "_map, _against"), names


class KernelMap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: the kernel map of some columns as one column.

    A vector column (NaN where a feature is missing) for Spark ML's estimators, or with
    ``as_array`` an array, null where a feature is null.
    """

    state = Param(Params._dummy(), "state", "columns, matrices and settings as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the mapped column", TypeConverters.toString)

    def __init__(self, state: dict | None = None, output: str | None = None):
        super().__init__()
        if state is not None:
            self._set(state=json.dumps(state), outputCol=output)

    @classmethod
    def fourier(cls, cols: Sequence[str], gamma: float | None = None, n_components: int = 100, seed: int = 0) -> KernelMap:
        """The map of :func:`fourier_statement`."""
        gamma = 1.0 / max(len(cols), 1) if gamma is None else gamma
        w, b = zip(*fourier_draws(len(cols), n_components, gamma, seed), strict=True)
        return cls({"cols": list(cols), "kernel": "rbf", "w": w, "b": b}, "features")

    @classmethod
    def nystroem(cls, df: DataFrame, cols: Sequence[str], kernel: str, n_components: int = 100, gamma: float | None = None,
                 coef0: float = 0.0, degree: int = 3) -> KernelMap:
        """The map of :func:`nystroem_statement`."""
        gamma = 1.0 / max(len(cols), 1) if gamma is None else gamma
        marks, root = landmarks(df, cols, kernel, n_components, gamma, coef0, degree)
        return cls({"cols": list(cols), "kernel": kernel, "marks": marks.tolist(), "root": root.tolist(), "gamma": float(gamma),
                    "coef0": float(coef0), "degree": int(degree)}, "features")

    def arrays(self, output: str) -> KernelMap:
        """The same map as an array column."""
        return KernelMap({**json.loads(self.getOrDefault(self.state)), "as_array": True}, output)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault(self.state))
        a, b = (np.array(s[k], float) for k in (("w", "b") if s["kernel"] == "rbf" else ("marks", "root")))

        @F.pandas_udf("array<double>")
        def mapped(*xs: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(float) for v in xs])
            if s["kernel"] == "rbf":
                out = math.sqrt(2.0 / len(b)) * np.cos(x @ a.T + b)
            else:
                out = kernel_matrix(x, a, s["kernel"], s["gamma"], s["coef0"], s["degree"]) @ b
            return pd.Series(list(out))

        cols = [F.col(f"`{c}`").cast("double") for c in s["cols"]]
        out = F.transform(mapped(*cols), lambda v: F.coalesce(v, F.lit(float("nan"))))  # Arrow turns a NaN in a list into a null
        if s.get("as_array"):
            null = cols[0].isNull()
            for c in cols[1:]:
                null = null | c.isNull()
            out = F.when(~null, out)
        else:
            out = array_to_vector(out)
        return dataset.withColumn(self.getOrDefault(self.outputCol), out)


# ---------------------------------------------------------------- support-vector regression

def _newton_sums(w: np.ndarray, epsilon: float):
    """Per task: loss, and the Gram matrix and right side of the rows outside the tube."""
    d = len(w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d + d * d)
        for f in frames:
            if not len(f):
                continue
            x = np.hstack([np.stack(f["x"]), np.ones((len(f), 1))])
            y = f["y"].to_numpy(float)
            gap = x @ w - y
            out = np.abs(gap) > epsilon
            x, y, side = x[out], y[out], np.sign(gap[out])
            total[0] += ((np.abs(gap[out]) - epsilon) ** 2).sum()
            total[1:d + 1] += x.T @ (y + side * epsilon)
            total[d + 1:] += (x.T @ x).ravel()
        yield pd.DataFrame({"at": np.arange(len(total)), "v": total})
    return run


def support_vector_regression(df: DataFrame, names: str | Sequence[str], label: str = "label", c: float = 1.0, epsilon: float = 0.1,
                              max_iter: int = 30) -> np.ndarray:
    """Weights and intercept that minimise |w|^2 / 2 + c sum max(0, |y - f| - epsilon)^2.

    ``names`` are the feature columns, or one column that holds them as an array.
    Newton steps (Ho & Lin 2012): every pass over the rows adds up the normal equations of those outside
    the epsilon tube, summed by Spark; a step that does not lower the objective is
    halved.  Rows with a null feature or label are left out.
    """
    row = F.col(f"`{names}`") if isinstance(names, str) else F.array(*[F.col(n).cast("double") for n in names])
    data = (df.select(row.alias("x"), F.col(label).cast("double").alias("y"))
            .where("y is not null and x is not null").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).persist())
    first = data.select(F.size("x")).first() if isinstance(names, str) else [len(names)]
    if first is None:
        raise ValueError("no row with a label and all features")
    d = first[0] + 1
    ridge = np.eye(d)
    ridge[-1, -1] = 1e-9  # the intercept is free

    def objective(w):
        got = data.mapInPandas(_newton_sums(w, epsilon), "at long, v double").groupBy("at").agg(F.sum("v")).collect()
        total = np.zeros(1 + d + d * d)
        for at, v in got:
            total[at] = v
        return w[:-1] @ w[:-1] / 2 + c * total[0], total[1:d + 1], total[d + 1:].reshape(d, d)
    try:
        w = np.zeros(d)
        value, side, gram = objective(w)
        for _ in range(max_iter):
            goal = np.linalg.solve(ridge + 2 * c * gram, 2 * c * side)
            step = 1.0
            while True:
                tried = w + step * (goal - w)
                got = objective(tried)
                if got[0] <= value or step < 1e-3:
                    break
                step /= 2
            gain = value - got[0]
            if gain > 0:
                w, (value, side, gram) = tried, got
            if gain <= 1e-9 * max(abs(value), 1e-12):
                break
        return w
    finally:
        data.unpersist()


def fit_svr(df: DataFrame, kernel_map: KernelMap | None, names: Sequence[str], label: str = "label", c: float = 1.0,
            epsilon: float = 0.1) -> PipelineModel:
    """Support-vector regression as a saveable pipeline: the kernel map (if any) and the prediction as SQL."""
    if kernel_map is None:
        w = support_vector_regression(df, names, label, c, epsilon)
        return PipelineModel(stages=[SQLTransformer(
            statement=f"SELECT *, {_dot(_row(names), _numbers(w[:-1]))} + {float(w[-1])!r}D AS prediction FROM __THIS__")])
    stage = kernel_map.arrays("_kernel_map")
    w = support_vector_regression(stage.transform(df), "_kernel_map", label, c, epsilon)
    return PipelineModel(stages=[stage, SQLTransformer(
        statement=f"SELECT * EXCEPT (_kernel_map), {_dot('_kernel_map', _numbers(w[:-1]))} + {float(w[-1])!r}D AS prediction FROM __THIS__")])
