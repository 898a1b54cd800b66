"""Embedding whitening by shifted CholeskyQR.

The centred rows X (n x d) are never gathered.  A Gram pass adds up Q'Q over all
rows, d x d numbers a task; the driver factors it, Q'Q + s I = R'R, and the next
pass takes Q R^-1 for Q, row by row through triangular solves.  The shift s of the
first pass keeps the factorisation from breaking down on ill-conditioned rows; each
pass brings Q closer to orthonormal columns, and the product R = R_k ... R_1 stays
the triangular factor of X.  The singular values and right vectors of R (d x d) are
those of X: the variances are their squares over n, the components the right vectors.
Unlike the eigenvectors of one Gram matrix they do not lose the small variances to
the square of the condition number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import saved
from lucerna.llm.vectors import matrix, whole_vectors

LIMIT = 2 ** 40  # scaled components beyond count as this
PASSES = 6  # Gram passes at most; three are enough unless columns depend on each other
ORTHONORMAL = 1e-13  # deviation of Q'Q from the identity at which the passes end


@dataclass(frozen=True)
class Whitening:
    """Means, components (d x k, by falling variance) and what is needed to apply them."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number rows; 0 where a component has no variance."""
        scale = np.divide(1.0, np.sqrt(self.variances), out=np.zeros_like(self.variances), where=self.variances > 0)
        return (self.centred(x) @ self.vectors) * scale

    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros_like(self.variances)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n: the whole part is taken off in whole numbers, so large means cost no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def solve_right(x: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """x R^-1 for an upper triangular R, by substitution."""
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        out[:, j] = (x[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            if batch.num_rows:
                total = [a + b for a, b in zip(total, matrix(batch, dim).sum(0).tolist(), strict=True)]
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), dim], pa.int64()), pa.array([str(v) for v in (*total, n)])],
                                         ["at", "total"])
    return run


def column_sums(vectors: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of every dimension."""
    rows = (vectors.select("x").mapInArrow(_sums(dim), "at long, total string")
            .groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    found = {r["at"]: int(r["total"]) for r in rows}
    return found.get(dim, 0), tuple(found.get(j, 0) for j in range(dim))


def gram(rows: DataFrame, dim: int, transform) -> np.ndarray:
    """Sum of q q' over all rows, q being what ``transform`` makes of a batch (rows x dim)."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            q = transform(batch)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "v"])

    out = np.zeros((dim, dim))
    for i, j, v in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g + shift I; a shift that is too small for the rounding errors is raised."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, float(np.trace(g)) * 1e-16, 1e-300)


def triangular_factor(vectors: DataFrame, dim: int, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """R with X = Q R and the sum of squares of X, by shifted CholeskyQR over the centred rows X."""
    factors: list[np.ndarray] = []
    total, product = 0.0, np.eye(dim)
    for _ in range(PASSES):
        def rows(batch, factors=tuple(factors)):
            q = centred(matrix(batch, dim), n, sums)
            for r in factors:
                q = solve_right(q, r)
            return q
        g = gram(vectors.select("x"), dim, rows)
        if not factors:
            total = float(np.trace(g))
            if total <= 0:
                return np.zeros((dim, dim)), 0.0
        elif np.abs(g - np.eye(dim)).max() <= ORTHONORMAL:
            break
        # the bound on rounding errors of a Gram matrix of n rows, times its norm
        rounding = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(g, 2))
        r = cholesky(g, rounding if not factors else 0.0)
        factors.append(r)
        product = r @ product
    return product, total


def fit(vectors: DataFrame, dim: int, components: int = 8) -> Whitening:
    """Whitening components of all rows of ``vectors(x)``."""
    n, sums = column_sums(vectors, dim)
    r, total = triangular_factor(vectors, dim, n, sums) if n else (np.zeros((dim, dim)), 0.0)
    _, s, right = np.linalg.svd(r)
    s = np.where(s > s.max(initial=0) * dim * np.finfo(float).eps, s, 0.0)  # below: rounding, not variance
    k = min(components, dim)
    return Whitening(n, sums, right[:k].T.copy(), s[:k] ** 2 / max(n, 1), total / max(n, 1))


def _apply(model: Whitening, dim: int):
    # n x - S and the sum of its squares stay exact: in 64 bits while they fit, else in Python's whole numbers
    sums = np.array(model.sums, object)

    def deviation(x: np.ndarray) -> list[int]:
        gap = int(np.abs(x).max(initial=0)) * model.n + max((abs(s) for s in model.sums), default=0)
        if gap * gap * dim < 2 ** 63:
            y = x * model.n - sums.astype(np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        y = x.astype(object) * model.n - sums
        return (y * y).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([str(v) for v in deviation(x)], pa.string()),
                 pa.array(list(model.apply(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])
    return run


def identity_error(rows: DataFrame, n: int, k: int, used: int) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity, over the first ``used`` components."""
    if not n or not used:
        return 0.0
    values = lambda b: matrix(b, k, "whitened")[:, :used]
    means = np.array(rows.agg(*[F.sum(F.col("whitened")[j]) for j in range(used)]).first()) / n
    g = gram(rows.select("whitened"), used, lambda b: values(b) - means)
    return float(np.abs(g / n - np.eye(used)).max())


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1024, add: int = 100_000) -> tuple[DataFrame, Whitening, float]:
    """``(vec_id, deviation decimal(38,0), whitened array<double>)`` of ``embeddings(vec_id, embedding)``, the model and its identity error.

    One row per kept row, repeated rows as often as they come.  Rows whose vector
    is null, empty or holds a null, NaN or infinite component, or is of another
    length than the commonest one, are left out; scaled components beyond 2^40
    count as that.  Null ids are kept.  Equal variances give any orthonormal pair of
    their plane.  Components without variance (constant or repeated dimensions,
    fewer rows than components) have whitened 0 and are left out of the identity
    error.  An empty table gives no rows.  Other columns are ignored.
    """
    vectors, dim = whole_vectors(embeddings.select("vec_id", "embedding"), "embedding", scale, add, LIMIT, "whitening-x")
    model = fit(vectors, dim, components)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "x").mapInArrow(_apply(model, dim), f"vec_id {kind}, deviation string, whitened array<double>")
    rows = saved(rows.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")), "whitening")
    used = int((model.variances > 0).sum())
    return rows, model, identity_error(rows, model.n, len(model.variances), used)


def report(embeddings: DataFrame) -> DataFrame:
    """One row per kept row and component up to 8, with the model's figures.

    ``(vec_id, component, n, deviation, whitened, explained, identity_error)``;
    a deviation beyond 64 bits is null here (``whiten`` has it in full).
    """
    rows, model, error = whiten(embeddings)
    share = F.array(*[F.lit(float(v)) for v in model.explained()]) if len(model.variances) else F.array().cast("array<double>")
    return rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
                       F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
