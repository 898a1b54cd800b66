"""EX6 exact Shapley values of tree models against a background table (interventional).

A leaf is reached where every feature on its path lies in the path's interval of it.
Take the explained row's value of a feature or a background row's: the leaf counts if
each path feature has a value inside from the side it is taken from.  With a features
that only the explained row has inside and b that only the background row has, the
Shapley value of the leaf's value v is v (a-1)! b! / (a+b)! for each of the former and
-v a! (b-1)! / (a+b)! for each of the latter, and nothing where a feature is outside
in both.  So all a background row tells a leaf is a mask of the path features it has inside.

1. One pass over the background counts (leaf, mask): a table bounded by the model.
2. From it the driver works out each leaf's sums for every mask: bounded by the model, too.
3. One pass over the rows to explain looks them up by the row's own mask.

The masks of a block of leaves are looked up by the places of a row's values among the borders.

No subsets, no orders and no pairs of rows are formed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import factorial, inf

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.session import checkpoint_dir


@dataclass(frozen=True)
class Leaf:
    """A leaf's share of the score and its path: (feature, above, up to) of every feature on it."""

    value: float
    path: tuple[tuple[int, float, float], ...]


def leaves_of(df: DataFrame, model: PipelineModel, class_index: int | None = 1) -> list[Leaf]:
    """The leaves of a pipeline's last stage, a decision tree, random forest or boosted trees.

    The score that they add up to is the probability of ``class_index`` (trees and
    forests that classify), the margin (boosted classifiers) or the prediction.
    The node table is what Spark's model writer saves; models, not data, are read here.
    """
    spark, stage = df.sparkSession, model.stages[-1]
    path = os.path.join(checkpoint_dir(spark), f"tree-model-{uuid.uuid4().hex}")
    stage.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    if "treeID" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
        weights = {r["treeID"]: r["weights"] for r in spark.read.parquet(os.path.join(path, "treesMetadata")).toDF("treeID", "metadata", "weights").collect()}
    else:
        nodes, weights = nodes.withColumn("treeID", F.lit(0)), {0: 1.0}
    rows = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex",
                        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), "split.numCategories").collect()
    forest = "RandomForest" in type(stage).__name__
    votes = class_index is not None and "Classification" in type(stage).__name__ and "GBT" not in type(stage).__name__
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out: list[Leaf] = []

    def walk(tree: dict, at: int, inside: dict[int, tuple[float, float]], weight: float) -> None:
        r = tree[at]
        if r["leftChild"] is None or r["leftChild"] < 0:
            stats = r["impurityStats"]
            value = stats[class_index] / sum(stats) if votes else r["prediction"]
            if value:
                out.append(Leaf(weight * value, tuple((f, lo, hi) for f, (lo, hi) in sorted(inside.items()))))
            return
        if r["numCategories"] is not None and r["numCategories"] >= 0:
            raise ValueError("splits on categories are not offered")
        f, t = r["featureIndex"], r["threshold"]
        lo, hi = inside.get(f, (-inf, inf))
        walk(tree, r["leftChild"], {**inside, f: (lo, min(hi, t))}, weight)
        walk(tree, r["rightChild"], {**inside, f: (max(lo, t), hi)}, weight)
    for t, tree in sorted(trees.items()):
        walk(tree, 0, {}, 1.0 / len(trees) if forest else float(weights[t]))
    return out


def _masks(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Per row, the bits of the path features that lie inside."""
    out = np.zeros(len(x), np.int64)
    for k, (f, lo, hi) in enumerate(leaf.path):
        out |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << k
    return out


TABLED = 8  # path features up to which a leaf's sums are tabled for every mask
LEAVES = 256  # leaves whose masks are looked up together


class _Look:
    """Masks of many leaves at once, by the place of a row's values among the model's borders.

    Between two borders of a feature every value lies inside the same paths, so a
    feature's share of the masks of a block of leaves is one row of a table.
    """

    def __init__(self, leaves: list[Leaf], n_features: int):
        borders: list[set[float]] = [set() for _ in range(n_features)]
        for leaf in leaves:
            for f, lo, hi in leaf.path:
                borders[f].update(b for b in (lo, hi) if abs(b) != inf)
        self.borders = [np.array(sorted(b)) for b in borders]
        self.blocks: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = []  # leaves, bits by the place of each feature in use
        # behind the others is the place of what lies outside every interval: no number, or minus infinity
        probes = [np.concatenate([b, [b[-1] + abs(b[-1]) + 1.0 if len(b) else 0.0, np.nan]]) for b in self.borders]
        for d in sorted({len(leaf.path) for leaf in leaves if 0 < len(leaf.path) <= TABLED}):
            of = np.array([i for i, leaf in enumerate(leaves) if len(leaf.path) == d])
            for at in range(0, len(of), LEAVES):
                block = of[at:at + LEAVES]
                tables = {}
                for j, i in enumerate(block):
                    for k, (f, lo, hi) in enumerate(leaves[i].path):
                        table = tables.setdefault(f, np.zeros((len(probes[f]), len(block)), np.uint8))
                        table[:, j] |= ((probes[f] > lo) & (probes[f] <= hi)).astype(np.uint8) << k
                self.blocks.append((block, sorted(tables.items())))
        self.single = [i for i, leaf in enumerate(leaves) if len(leaf.path) > TABLED]

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.where(np.isnan(x[:, f]) | (x[:, f] == -inf), len(b) + 1, np.searchsorted(b, x[:, f])) for f, b in enumerate(self.borders)]

    @staticmethod
    def masks(tables: list[tuple[int, np.ndarray]], places: list[np.ndarray]) -> np.ndarray:
        """``(rows, leaves of the block)``."""
        out = None
        for f, table in tables:
            out = table[places[f]] if out is None else np.bitwise_or(out, table[places[f]], out=out)
        return out


def _count_masks(leaves: list[Leaf], cols: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _Look(leaves, len(cols))
        sizes = [1 << len(leaves[block[0]].path) for block, _ in look.blocks]
        counts = [np.zeros(len(block) * size, np.int64) for (block, _), size in zip(look.blocks, sizes, strict=True)]
        total: dict[tuple[int, int], int] = {}
        for f in frames:
            for x in _pieces(f[cols].to_numpy(float)):
                places = look.places(x)
                for (block, tables), size, count in zip(look.blocks, sizes, counts, strict=True):
                    cell = look.masks(tables, places) + (np.arange(len(block)) * size)[None, :]
                    count += np.bincount(cell.ravel(), minlength=len(count))
                for i, leaf in enumerate(leaves):
                    if not leaf.path:
                        total[(i, 0)] = total.get((i, 0), 0) + len(x)
                for i in look.single:
                    for m, n in zip(*(v.tolist() for v in np.unique(_masks(x, leaves[i]), return_counts=True)), strict=True):
                        total[(i, m)] = total.get((i, m), 0) + n
        out = [pd.DataFrame([(i, m, n) for (i, m), n in total.items()], columns=["leaf", "mask", "n"])]
        for (block, _), size, count in zip(look.blocks, sizes, counts, strict=True):
            met = np.flatnonzero(count)
            out.append(pd.DataFrame({"leaf": block[met // size], "mask": met % size, "n": count[met]}))
        yield pd.concat([o for o in out if len(o)] or out[:1])
    return run


def _pieces(x: np.ndarray, rows: int = 2048) -> Iterator[np.ndarray]:
    for at in range(0, len(x), rows):
        yield x[at:at + rows]


@lru_cache(None)
def _weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """(a-1)! b! / (a+b)! and a! (b-1)! / (a+b)! for a, b up to ``d`` (0 where the feature to credit is missing)."""
    plus = [[factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0 for b in range(d + 1)] for a in range(d + 1)]
    return np.array(plus), np.array(plus).T


class _Sums:
    """Attributions of a leaf's path features by the explained row's mask, worked out when first asked for."""

    def __init__(self, leaf: Leaf, masks: np.ndarray, shares: np.ndarray):
        self.leaf, self.masks, self.shares, self.known = leaf, masks, shares, {}

    def __call__(self, own: int) -> np.ndarray:
        if own not in self.known:
            d = len(self.leaf.path)
            out = np.zeros(d)
            met = self.masks | own == (1 << d) - 1
            masks, shares = self.masks[met], self.shares[met]
            mine, theirs = own & ~masks, masks & ~own
            a, b = np.bitwise_count(mine).astype(int), np.bitwise_count(theirs).astype(int)
            plus, minus = (table[a, b] for table in _weights(d))
            for k in range(d):
                out[k] = self.leaf.value * (shares * (plus * (mine >> k & 1) - minus * (theirs >> k & 1))).sum()
            self.known[own] = out
        return self.known[own]

    def table(self, n_features: int) -> np.ndarray:
        """``(masks, features)``: the attributions for every mask that a row may have."""
        d = len(self.leaf.path)
        own, masks = np.arange(1 << d)[:, None], self.masks[None, :]
        mine, theirs = own & ~masks, masks & ~own
        a, b = np.bitwise_count(mine).astype(int), np.bitwise_count(theirs).astype(int)
        met = (masks | own == (1 << d) - 1) * self.shares[None, :] * self.leaf.value
        plus, minus = (table[a, b] * met for table in _weights(d))
        out = np.zeros((1 << d, n_features))
        for k, (f, _, _) in enumerate(self.leaf.path):
            out[:, f] = (plus * (mine >> k & 1) - minus * (theirs >> k & 1)).sum(1)
        return out


def tree_shapley(rows: DataFrame, background: DataFrame, model: PipelineModel, feature_cols: Sequence[str],
                 id_col: str = "id", class_index: int | None = 1) -> DataFrame:
    """EX6: ``id, feature, attribution`` of every row and feature of a tree model.

    A row's attributions add up to its score minus the mean score of
    ``background``; the score is that of :func:`leaves_of`.  Values are doubles as
    the model compares them; a null or NaN lies outside every interval that has a border.
    """
    cols = list(feature_cols)
    leaves = leaves_of(rows, model, class_index)
    if not leaves:
        return rows.select(id_col, F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"), F.lit(0.0).alias("attribution"))
    values = [F.col(c).cast("double").alias(c) for c in cols]
    counted = (background.select(*values).mapInPandas(_count_masks(leaves, cols), "leaf long, mask long, n long")
               .groupBy("leaf", "mask").agg(F.sum("n").alias("n")).toPandas())  # leaves x 2^(path features) at most
    total = counted[counted.leaf == 0]["n"].sum() or 1
    by_leaf = {i: (g["mask"].to_numpy(), g["n"].to_numpy() / total) for i, g in counted.groupby("leaf")}

    none = (np.empty(0, np.int64), np.empty(0))
    look, d = _Look(leaves, len(cols)), len(cols)
    sums = [_Sums(leaf, *by_leaf.get(i, none)) for i, leaf in enumerate(leaves)]
    # one table a leaf, 2^(path features) masks by features: bounded by the model
    shared = rows.sparkSession.sparkContext.broadcast((look, [np.concatenate([sums[i].table(d) for i in block]) for block, _ in look.blocks]))
    rest = [(leaves[i], sums[i]) for i in look.single]

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look, tables = shared.value
        for f in frames:
            out = np.zeros((len(f), d))
            for part, x in zip(_pieces(out), _pieces(f[cols].to_numpy(float)), strict=True):
                places = look.places(x)
                for (block, bits), table in zip(look.blocks, tables, strict=True):
                    cell = look.masks(bits, places) + (np.arange(len(block)) * (len(table) // len(block)))[None, :]
                    for j in range(len(block)):
                        part += table[cell[:, j]]
                for leaf, of in rest:
                    distinct, which = np.unique(_masks(x, leaf), return_inverse=True)
                    part[:, [p[0] for p in leaf.path]] += np.stack([of(int(m)) for m in distinct])[which]
            yield pd.DataFrame({id_col: np.repeat(f[id_col].to_numpy(), d), "feature": np.tile(cols, len(f)), "attribution": out.ravel()})
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, *values).mapInPandas(explain, f"`{id_col}` {kind}, feature string, attribution double")
