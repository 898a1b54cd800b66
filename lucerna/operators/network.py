"""ML5: dense networks of any depth for classes and numbers, trained on mini-batches.

The rows are written once, partitioned by the mini-batch that a hash of the whole row
gives them, so a step reads its own batch and an epoch the table once.  A step is one job:
tasks run the batch forwards and back and add up their gradient, Spark sums the tasks'
gradients parameter by parameter, and one vector of the model's size reaches the driver.
Weights, draws of dropped units and the order of batches depend on the seed and the rows
alone, so a task that runs again gives the same sums.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.local_fit import uniform_of
from lucerna.operators.boosting import gradients
from lucerna.operators.stages import MarginModel
from lucerna.session import scratch_path

ACTIVATIONS = {  # the function, and its slope from its value
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0.0))), lambda a: np.where(a > 0, 1.0, a + 1.0)),
    "tanh": (np.tanh, lambda a: 1.0 - a ** 2),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1.0 - a)),
    "linear": (lambda z: z, lambda a: np.ones_like(a)),
}


@dataclass
class Network:
    """A dense network over standardised features; a missing feature counts as its mean."""

    features: list[str]
    task: str
    n_classes: int
    hidden: list[int]
    activation: str
    centre: list[float]
    spread: list[float]
    label_centre: float = 0.0
    label_spread: float = 1.0
    weights: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)  # mean training loss of each epoch

    @property
    def outputs(self) -> int:
        return self.n_classes if self.task == "classification" and self.n_classes > 2 else 1

    @property
    def sizes(self) -> list[int]:
        return [len(self.features), *self.hidden, self.outputs]

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of a flat vector as (matrix, offsets) of each layer."""
        out, at = [], 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.centre)) / np.array(self.spread)
        return np.where(np.isnan(z), 0.0, z)

    def forward(self, z: np.ndarray, weights: np.ndarray, masks: list | None = None) -> list[np.ndarray]:
        """Values of every layer; ``masks`` scale the hidden ones."""
        act, layers, values = ACTIVATIONS[self.activation][0], self.layers(weights), [z]
        for i, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            if i < len(layers) - 1:
                z = act(z)
                if masks:
                    z = z * masks[i]
            values.append(z)
        return values

    def loss_and_gradient(self, z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, masks: list | None = None):
        """Weighted loss and gradient summed over the rows."""
        slope, layers = ACTIVATIONS[self.activation][1], self.layers(weights)
        values = self.forward(z, weights, masks)
        loss, g, _ = gradients(values[-1], y, self.task)
        g = g * w[:, None]
        parts = []
        for i in range(len(layers) - 1, -1, -1):
            parts += [g.sum(0), (values[i].T @ g).ravel()]
            if i:
                back = g @ layers[i][0].T
                value = values[i]
                if masks:
                    back, value = back * masks[i - 1], np.divide(value, masks[i - 1], out=np.zeros_like(value), where=masks[i - 1] > 0)
                g = back * slope(value)
        return float(loss @ w), np.concatenate(parts[::-1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = self.forward(self.standard(x), np.array(self.weights))[-1]
        return out * self.label_spread + self.label_centre if self.task == "regression" else out

    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[NetworkModel(json.dumps(asdict(self)))])


class NetworkModel(MarginModel):
    """A fitted network as a pipeline stage."""

    def load_state(self, text: str) -> Network:
        return Network(**json.loads(text))


class _Step:
    """Optimisers: a step from the mean gradient."""

    def __init__(self, kind: str, rate: float, size: int):
        self.kind, self.rate, self.t = kind, rate, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        if self.kind == "sgd":
            self.mean = 0.9 * self.mean + g
            return -self.rate * self.mean
        if self.kind == "rmsprop":
            self.square = 0.9 * self.square + 0.1 * g ** 2
            return -self.rate * g / (np.sqrt(self.square) + 1e-7)
        self.mean = 0.9 * self.mean + 0.1 * g
        self.square = 0.999 * self.square + 0.001 * g ** 2
        return -self.rate * (self.mean / (1 - 0.9 ** self.t)) / (np.sqrt(self.square / (1 - 0.999 ** self.t)) + 1e-8)


OPTIMIZERS = ("adam", "sgd", "rmsprop")


def _gradient_sums(job):
    """mapInArrow body: (parameter, sum) of a task's rows; -2 is the loss, -1 the weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, weights, dropout, salt = job.value
        total, loss, mass = np.zeros(len(weights)), 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            z = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            masks = None
            if dropout:
                key = b.column("key").to_numpy(zero_copy_only=False)
                masks = [np.column_stack([uniform_of(key, salt * 1_000_003 + i * 10_007 + u) >= dropout for u in range(size)]) / (1 - dropout)
                         for i, size in enumerate(net.hidden)]
            part, g = net.loss_and_gradient(z, y, w, weights, masks)
            loss, mass, total = loss + part, mass + w.sum(), total + g
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(total)), pa.int64()), pa.array(np.concatenate([[loss, mass], total]))], ["at", "v"])
    return run


def _prepared(df: DataFrame, net: Network, label: str, weight_col: str | None, batches: int) -> list[DataFrame]:
    """The rows of each mini-batch, standardised, read from a table partitioned by batch."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    z = [F.coalesce(F.nanvl((F.col(c).cast("double") - m) / s, F.lit(0.0)), F.lit(0.0)) for c, m, s in zip(net.features, net.centre, net.spread, strict=True)]
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    rows = df.where(F.col(label).isNotNull()).select(
        key.alias("key"), F.array(*z).alias("z"), ((F.col(label).cast("double") - net.label_centre) / net.label_spread).alias("y"),
        weight.alias("w"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch"))
    path = scratch_path(df.sparkSession, f"network-{uuid.uuid4().hex}")
    rows.write.partitionBy("batch").parquet(path)
    table = df.sparkSession.read.schema(rows.schema).parquet(path)
    return [table.where(F.col("batch") == i).drop("batch") for i in range(batches)]


def fit_network(df: DataFrame, feature_cols: Sequence[str], task: str = "classification", n_classes: int = 2, label: str = "label",
                weight_col: str | None = None, hidden: Sequence[int] = (16, 8), activation: str = "relu", dropout: float = 0.0,
                optimizer: str = "adam", learning_rate: float = 0.01, epochs: int = 40, batches: int = 2, l2: float = 0.0,
                seed: int = 2020) -> Network:
    """Train a dense network with ``hidden`` layers by log-loss, softmax or squared error.

    ``batches`` mini-batches an epoch, in an order drawn anew each time; exact copies of
    a row are in one batch.  ``dropout`` is the share of hidden units left out per row
    and step (the others are scaled up), ``l2`` the weight decay of all but the offsets.
    Features and a numeric target are standardised; a constant feature stays 0.  Rows
    without a label are left out; classes must be the whole numbers below ``n_classes``.
    """
    cols = list(feature_cols)
    if activation not in ACTIVATIONS or optimizer not in OPTIMIZERS or not 0 <= dropout < 1 or batches < 1 or epochs < 1:
        raise ValueError(f"unknown or out of range: {activation}, {optimizer}, dropout {dropout}, {batches} batches, {epochs} epochs")
    y = F.col(label).cast("double")
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    row = df.where(y.isNotNull()).agg(F.count(y), F.count_if(~((y >= 0) & (y < n_classes) & (y == F.floor(y)))), F.avg(y), F.stddev_pop(y),
                                      *[F.avg(v) for v in x], *[F.stddev_pop(v) for v in x]).first()
    if not row[0]:
        raise ValueError("no row with a label")
    if task == "classification" and row[1]:
        raise ValueError(f"{row[1]} labels are not whole numbers from 0 to {n_classes - 1}")
    centre, spread = row[4:4 + len(cols)], row[4 + len(cols):]
    net = Network(cols, task, n_classes, list(hidden), activation, [m or 0.0 for m in centre], [s or 1.0 for s in spread])
    if task == "regression":
        net.label_centre, net.label_spread = row[2], row[3] or 1.0
    rng = np.random.default_rng(seed)
    gain = 2.0 if activation in ("relu", "elu") else 1.0
    weights = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(gain / a), a * b), np.zeros(b)])
                              for a, b in zip(net.sizes[:-1], net.sizes[1:], strict=True)])
    decay = np.concatenate([np.concatenate([np.full(a * b, l2), np.zeros(b)]) for a, b in zip(net.sizes[:-1], net.sizes[1:], strict=True)])
    tables, order = _prepared(df, net, label, weight_col, batches), random.Random(seed)
    sc, step = df.sparkSession.sparkContext, _Step(optimizer, learning_rate, len(weights))
    for epoch in range(epochs):
        losses = np.zeros(2)
        for at, b in enumerate(order.sample(range(batches), batches)):
            job = sc.broadcast((net, weights, dropout, seed + epoch * batches + at))
            sums = tables[b].mapInArrow(_gradient_sums(job), "at long, v double").groupBy("at").agg(F.sum("v")).collect()
            job.destroy()
            if not sums:  # no row fell into this batch
                continue
            total = np.zeros(len(weights) + 2)
            for i, v in sums:
                total[i + 2] = v
            losses += total[:2]
            weights = weights + step(total[2:] / total[1] + decay * weights)
        net.history.append(float(losses[0] / losses[1]))
    net.weights = weights.tolist()
    return net
