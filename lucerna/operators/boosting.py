"""ML4: second-order gradient boosting on histograms (Chen & Guestrin 2016).

Each level of a round's trees is one job over the rows:

1. a task finds the node of its rows and adds up gradients and Hessians per (class, node, feature, bin);
2. the tasks' histograms meet by (class, node, feature), where the best cut of that feature is found;
3. one row per (class, node, feature) reaches the driver, which takes the best feature of every node.

Rows are kept as bin numbers with their margins, in blocks of bytes.  The margins are written anew every few
rounds to the checkpoint folder; the trees since then are applied where the rows are, so no
row is scored with more than ``rewrite`` rounds in a pass.  What a task or the driver holds
is bounded by the model: classes x nodes x features x bins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.local_fit import uniform_of
from lucerna.operators.stages import MarginModel
from lucerna.session import scratch_path

LEAST_GAIN = 1e-9
KINDS = {"key": np.int64, "bins": np.int16, "y": np.float64, "w": np.float64, "margin": np.float64}  # columns of a block
BLOCK = ", ".join(f"{c} binary" for c in KINDS)
CHUNK = 16_384  # rows that walk down a tree together
FOUND = "class int, node int, feature int, gain double, cut int, missing_left boolean, g double, h double, g_left double, h_left double"


@dataclass(frozen=True)
class Boosting:
    """Settings, named and preset as users of second-order boosting know them."""

    n_estimators: int = 100
    eta: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    alpha: float = 0.0
    subsample: float = 1.0
    scale_pos_weight: float = 1.0
    max_bin: int = 256
    rewrite: int = 10
    seed: int = 2020

    def __post_init__(self):
        if self.n_estimators < 1 or self.max_depth < 1 or self.max_bin < 2 or self.rewrite < 1 or not 0 < self.subsample <= 1:
            raise ValueError(f"settings out of range: {self}")

    def shrunk(self, g):
        """The gradient sum after the L1 penalty."""
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0.0)

    def quality(self, g, h):
        return self.shrunk(g) ** 2 / np.maximum(h + self.reg_lambda, 1e-300)

    def leaf(self, g: float, h: float) -> float:
        return float(-self.eta * self.shrunk(g) / max(h + self.reg_lambda, 1e-300))


@dataclass
class Tree:
    """A complete binary tree by heap position; an early leaf sends all rows to its leftmost descendant."""

    feature: np.ndarray
    cut: np.ndarray  # last bin that goes left
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, max_bin: int) -> Tree:
        inner = 2 ** depth - 1
        return cls(np.zeros(inner, np.int32), np.full(inner, max_bin, np.int32), np.ones(inner, bool), np.zeros(inner + 1))

    def place(self, bins: np.ndarray, levels: int, missing: int) -> np.ndarray:
        """Heap position of each row after ``levels`` steps."""
        # per (node, bin) the next position, and cells of the matrix by number: two look-ups a row and level
        width = missing + 1
        node = np.arange(len(self.feature))[:, None]
        left = np.arange(width)[None, :] <= self.cut[:, None]
        left[:, missing] = self.missing_left
        following = (2 * node + 2 - left).ravel()
        flat, d = np.ascontiguousarray(bins).ravel(), bins.shape[1]
        feature = self.feature.astype(np.int64)
        out = np.zeros(len(bins), np.int64)
        for lo in range(0, len(bins) if levels else 0, CHUNK):
            start = np.arange(lo, min(lo + CHUNK, len(bins))) * d
            at = np.zeros(len(start), np.int64)
            for _ in range(levels):
                at = following.take(at * width + flat.take(start + feature.take(at)))
            out[lo:lo + CHUNK] = at
        return out

    def margin(self, bins: np.ndarray, missing: int) -> np.ndarray:
        depth = len(self.value).bit_length() - 1
        return self.value[self.place(bins, depth, missing) - len(self.feature)]


@dataclass
class Boosted:
    """A fitted model: per round one tree per class (one in all for two classes and for numbers)."""

    features: list[str]
    task: str
    n_classes: int
    edges: list[np.ndarray]
    base: float
    rounds: list[list[Tree]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)  # mean loss before each round and after the last

    @property
    def outputs(self) -> int:
        return self.n_classes if self.task == "classification" and self.n_classes > 2 else 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Raw outputs of the rows of ``x``, all rows walking down a tree at once."""
        missing = max((len(e) for e in self.edges), default=0) + 1
        bins = np.column_stack([np.where(np.isnan(v), missing, np.searchsorted(e, v, side="left")) for v, e in zip(x.T, self.edges, strict=True)])
        out = np.full((len(x), self.outputs), self.base)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.margin(bins, missing)
        return out

    def to_json(self) -> str:
        trees = [[{f.name: getattr(t, f.name).tolist() for f in fields(Tree)} for t in r] for r in self.rounds]
        return json.dumps({"features": self.features, "task": self.task, "n_classes": self.n_classes, "base": self.base,
                           "edges": [e.tolist() for e in self.edges], "rounds": trees, "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        d["edges"] = [np.array(e, float) for e in d["edges"]]
        d["rounds"] = [[Tree(**{k: np.array(v) for k, v in t.items()}) for t in r] for r in d["rounds"]]
        return cls(**d)

    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[BoostedModel(self.to_json())])


# ---------------------------------------------------------------- rows

def _bin_edges(df: DataFrame, cols: Sequence[str], max_bin: int) -> list[np.ndarray]:
    """Up to ``max_bin - 1`` distinct quantiles per feature, by mergeable sketches in one pass; NaN counts as missing."""
    probs = [i / max_bin for i in range(1, max_bin)]
    x = {c: F.col(c).cast("double") for c in cols}
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(x[c]), x[c]), probs, 40 * max_bin).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(cols))]


def _binned(df: DataFrame, cols: Sequence[str], label: str, weight_col: str | None, edges: list[np.ndarray], settings: Boosting,
            outputs: int, base: float) -> DataFrame:
    """Blocks of ``(key, bins, y, w, margin)``: the key is a hash of the whole row, for draws of rows that can be repeated."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(
        F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
        F.col(label).cast("double").alias("y"), F.coalesce(weight, F.lit(0.0)).alias("w"))
    d, missing = len(cols), settings.max_bin

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, d)
            code = np.empty((n, d), np.int16)
            for j in range(d):
                code[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(edges[j], x[:, j], side="left"))
            if n:
                key, y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "y", "w"))
                yield _block(key, code, y, w, np.full((n, outputs), base))
    return rows.mapInArrow(bins, BLOCK)


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"boosting-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _block(*columns: np.ndarray) -> pa.RecordBatch:
    """Some thousand rows as one: every column as bytes, so that a level reads them without taking them apart."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c, t).tobytes()], pa.binary()) for c, t in zip(columns, KINDS.values(), strict=True)],
                                      list(KINDS))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[list[np.ndarray]]:
    """Key, bins (a matrix), y, w and margins (a matrix) of one block after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, bins, y, w, margin = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in KINDS.items())
            yield [key, bins.reshape(-1, d), y, w, margin.reshape(len(key), -1)]


def _margins(margin: np.ndarray, bins: np.ndarray, recent: list[list[Tree]], missing: int) -> np.ndarray:
    out = margin
    for trees in recent:
        out = out + np.column_stack([t.margin(bins, missing) for t in trees])
    return out


def _advance(recent: list[list[Tree]], d: int, missing: int):
    """mapInArrow body: the rows with the margins after the ``recent`` rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, bins, y, w, margin in _blocks(batches, d):
            yield _block(key, bins, y, w, _margins(margin, bins, recent, missing))
    return run


# ---------------------------------------------------------------- losses

def gradients(margin: np.ndarray, y: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradients, Hessians) per row: squared error / 2, log-loss, or softmax with the diagonal bound 2 p (1 - p)."""
    if task == "regression":
        g = margin - y[:, None]
        return g[:, 0] ** 2 / 2, g, np.ones_like(g)
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        return np.logaddexp(0, margin[:, 0]) - y * margin[:, 0], p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    shift = margin - margin.max(1, keepdims=True)
    total = np.exp(shift).sum(1)
    p = np.exp(shift) / total[:, None]
    own = y.astype(int)[:, None] == np.arange(margin.shape[1])
    return np.log(total) - shift[own], p - own, np.maximum(2 * p * (1 - p), 1e-16)


# ---------------------------------------------------------------- one level

def _histograms(job, task: str, d: int, settings: Boosting):
    """mapInArrow body: gradient and Hessian sums of a task's rows, one row per (class, node, feature).

    ``job`` broadcasts (round, level, recent rounds, the round's trees so far, open nodes per class).
    Row (-1, -1, -1) holds the loss and the weight.
    """
    width = settings.max_bin + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        round_no, level, recent, trees, opened = job.value
        first = 2 ** level - 1
        slot = [np.full(2 ** level, -1) for _ in trees]
        for s, nodes in zip(slot, opened, strict=True):
            s[np.array(nodes, int) - first] = np.arange(len(nodes))
        sums = [np.zeros((2, len(nodes), d, width)) for nodes in opened]
        loss = np.zeros(2)
        for key, bins, y, w, margin in _blocks(batches, d):
            each, g, h = gradients(_margins(margin, bins, recent, settings.max_bin), y, task)
            lines = np.ascontiguousarray(bins.T)
            if task == "classification" and g.shape[1] == 1:
                w = np.where(y == 1, w * settings.scale_pos_weight, w)
            loss += (each @ w, w.sum())
            if settings.subsample < 1:
                w = w * (uniform_of(key, round_no * 1_000_003 + settings.seed) < settings.subsample)
            for k, tree in enumerate(trees):
                if not opened[k]:
                    continue
                at = slot[k][tree.place(bins, level, settings.max_bin) - first]
                live = (at >= 0) & (w > 0)
                here = slice(None) if live.all() else live
                place, gw, hw = at[here] * width, (g[:, k] * w)[here], (h[:, k] * w)[here]
                for j in range(d):
                    cell, size = place + lines[j, here], len(opened[k]) * width
                    sums[k][0, :, j] += np.bincount(cell, gw, size).reshape(-1, width)
                    sums[k][1, :, j] += np.bincount(cell, hw, size).reshape(-1, width)
        if not loss[1]:
            return
        yield _parts([(-1, -1, -1, loss[:1], loss[1:])])
        for k, nodes in enumerate(opened):
            for i, node in enumerate(nodes):
                if sums[k][1, i].any():
                    yield _parts([(k, node, j, sums[k][0, i, j], sums[k][1, i, j]) for j in range(d)])
    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, g, h = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in (a, b, c)), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (g, h))],
                                      ["class", "node", "feature", "g", "h"])


def best_cut(g: np.ndarray, h: np.ndarray, settings: Boosting) -> tuple[float, int, bool, float, float]:
    """(gain, cut, whether missing values go left, left sums) of one histogram; its last bin holds the missing values."""
    total_g, total_h = g.sum(), h.sum()
    best = (-np.inf, settings.max_bin, True, total_g, total_h)
    for missing_left in (False, True):
        gl, hl = np.cumsum(g[:-1]) + missing_left * g[-1], np.cumsum(h[:-1]) + missing_left * h[-1]
        gr, hr = total_g - gl, total_h - hl
        gain = (settings.quality(gl, hl) + settings.quality(gr, hr) - settings.quality(total_g, total_h)) / 2 - settings.gamma
        allowed = (np.minimum(hl, hr) >= settings.min_child_weight) & (np.minimum(hl, hr) > 1e-12)
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), at, missing_left, float(gl[at]), float(hl[at]))
    return best


def _cuts(settings: Boosting):
    """mapInArrow body over rows that meet by (class, node, feature): the best cut of each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for a, n, f, g, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                both = np.stack([np.frombuffer(g), np.frombuffer(h)])
                total[a, n, f] = total[a, n, f] + both if (a, n, f) in total else both
        rows = []
        for key, (g, h) in total.items():
            if key[0] < 0:
                rows.append((*key, 0.0, 0, True, g[0], h[0], 0.0, 0.0))
            else:
                gain, cut, left, g_left, h_left = best_cut(g, h, settings)
                rows.append((*key, gain, cut, left, g.sum(), h.sum(), g_left, h_left))
        if rows:
            kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             [part.split()[0] for part in FOUND.split(", ")])
    return run


def _grow(rows: DataFrame, model: Boosted, recent: list[list[Tree]], settings: Boosting, round_no: int, last: bool = False) -> list[Tree]:
    """The trees of one round, level by level; the loss before it goes to the history (``last``: only that)."""
    d, sc = len(model.features), rows.sparkSession.sparkContext
    trees = [Tree.empty(settings.max_depth, settings.max_bin) for _ in range(model.outputs)]
    sums: dict[tuple[int, int], tuple[float, float]] = {}
    opened = [[] if last else [0] for _ in trees]

    def close(k: int, node: int, level: int) -> None:
        leftmost = (node + 1) * 2 ** (settings.max_depth - level) - 1
        trees[k].value[leftmost - len(trees[k].feature)] = settings.leaf(*sums[k, node])

    for level in range(settings.max_depth):
        job = sc.broadcast((round_no, level, recent, trees, opened))
        parts = rows.mapInArrow(_histograms(job, model.task, d, settings), "class int, node int, feature int, g binary, h binary")
        found = parts.repartition("class", "node", "feature").mapInArrow(_cuts(settings), FOUND).collect()
        job.destroy()
        best: dict[tuple[int, int], tuple] = {}
        for r in sorted(found, key=lambda r: (r["class"], r["node"], -r["gain"], r["feature"])):
            best.setdefault((r["class"], r["node"]), r)
        loss = best.pop((-1, -1))
        if level == 0:
            model.history.append(loss["g"] / loss["h"])
            for (k, _), r in best.items():
                sums[k, 0] = r["g"], r["h"]
        following: list[list[int]] = [[] for _ in trees]
        for (k, node), r in best.items():
            if r["gain"] <= LEAST_GAIN:
                close(k, node, level)
                continue
            tree = trees[k]
            tree.feature[node], tree.cut[node], tree.missing_left[node] = r["feature"], r["cut"], r["missing_left"]
            sums[k, 2 * node + 1] = r["g_left"], r["h_left"]
            sums[k, 2 * node + 2] = r["g"] - r["g_left"], r["h"] - r["h_left"]
            following[k] += [2 * node + 1, 2 * node + 2]
        opened = following
        if not any(opened):
            break
    else:
        for k, nodes in enumerate(opened):
            for node in nodes:
                close(k, node, settings.max_depth)
    return trees


# ---------------------------------------------------------------- fit and score

def fit_boosted(df: DataFrame, feature_cols: Sequence[str], task: str = "classification", n_classes: int = 2, label: str = "label",
                weight_col: str | None = None, **settings) -> Boosted:
    """Second-order boosting of squared error, log-loss (two classes) or softmax (more: one tree per class and round).

    ``settings`` are those of :class:`Boosting`.  Rows without a label are left out;
    missing features (null, NaN) take the side of a cut that gains more.  Equal gains
    go to the first feature, then the lowest cut.  ``subsample`` draws rows by a hash of
    the whole row, so exact copies are drawn together.  Fitting stops early once all leaves
    of a round are zero.  Classes must be the whole numbers below ``n_classes``.
    """
    cols, use = list(feature_cols), Boosting(**settings)
    y = F.col(label).cast("double")
    outside = F.count_if(~((y >= 0) & (y < n_classes) & (y == F.floor(y))))
    n, mean, bad = df.agg(F.count(y), F.avg(y), outside).first()
    if not n:
        raise ValueError("no row with a label")
    if task == "classification" and bad:
        raise ValueError(f"{bad} labels are not whole numbers from 0 to {n_classes - 1}")
    model = Boosted(cols, task, n_classes, _bin_edges(df.where(y.isNotNull()), cols, use.max_bin), mean if task == "regression" else 0.0)
    rows = _written(_binned(df, cols, label, weight_col, model.edges, use, model.outputs, model.base))
    since = 0
    for t in range(use.n_estimators):
        if t - since == use.rewrite:
            rows, since = _written(rows.mapInArrow(_advance(model.rounds[since:], len(cols), use.max_bin), rows.schema)), t
        trees = _grow(rows, model, model.rounds[since:], use, t)
        if all(np.abs(tree.value).max() <= LEAST_GAIN for tree in trees):
            return model
        model.rounds.append(trees)
    _grow(rows, model, model.rounds[since:], use, use.n_estimators, last=True)
    return model


class BoostedModel(MarginModel):
    """A fitted model as a pipeline stage."""

    def load_state(self, text: str) -> Boosted:
        return Boosted.from_json(text)
