"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import held_out, saved, text_slices
from lucerna.llm.textstats import base_counts

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "exclaims", "pipes", "stops", "commas",
            "beyond_ascii", "distinct", "top_word", "dup_lines", "repeats", "line_words", "entropy", "single_letters")


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; all are defined (zero) for an empty one."""
    n_words, chars, symbols, dup_lines, repeats = base_counts(text)
    n = max(1, len(text))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    share = byte[byte > 0] / n
    words = text.split()
    seen = Counter(words)
    lines = max(1, byte[10] + 1)
    w = max(1, n_words)
    return [float(np.log1p(n_words)), chars / w, symbols / n, byte[65:91].sum() / n, byte[48:58].sum() / n,
            byte[33] / n, byte[124] / n, byte[46] / n, byte[44] / n, byte[128:].sum() / n, len(seen) / w,
            max(seen.values(), default=0) / w, dup_lines / lines, repeats / w, n_words / lines,
            float(-(share * np.log(share)).sum()), sum(c for x, c in seen.items() if len(x) == 1) / w]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row, all rows walking each tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
          smooth: float = 5.0, least: int = 20) -> Trees:
    """Logistic boosting of weighted rows; splits are searched on histograms of quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    share = ((y * weight).sum() + 1) / (weight.sum() + 2)
    base = float(np.log(share / (1 - share)))
    f = np.full(n, base)
    out: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        roots.append(len(out))
        out.append([0, np.inf, len(out), len(out), 0.0])
        node = np.full(n, roots[-1])
        front = [roots[-1]]
        for _ in range(depth):
            place = {k: i for i, k in enumerate(front)}
            at = np.array([place.get(k, -1) for k in range(len(out))])[node]
            live = at >= 0
            gain, pick = np.zeros(len(front)), np.full((len(front), 2), -1)
            for j in range(d):
                size = len(edges[j]) + 1
                key = at[live] * size + binned[live, j]
                gs, hs, cs = (np.bincount(key, v, len(front) * size).reshape(-1, size)
                              for v in (g[live], h[live], weight[live]))
                gl, hl, cl = (np.cumsum(v, 1)[:, :-1] for v in (gs, hs, cs))
                gt, ht, ct = (v.sum(1, keepdims=True) for v in (gs, hs, cs))
                got = gl ** 2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt ** 2 / (ht + smooth)
                got[(cl < least) | (ct - cl < least)] = -1
                if size > 1:
                    best = got.argmax(1)
                    top = got[np.arange(len(front)), best]
                    better = top > gain + 1e-9
                    gain[better] = top[better]
                    pick[better, 0], pick[better, 1] = j, best[better]
            after = []
            for i, k in enumerate(front):
                j, b = pick[i]
                if j >= 0:
                    out[k][:4] = [j, edges[j][b], len(out), len(out) + 1]
                    for _ in range(2):
                        after.append(len(out))
                        out.append([0, np.inf, len(out), len(out), 0.0])
                    inside = node == k
                    node[inside] = np.where(binned[inside, j] <= b, out[k][2], out[k][3])
            front = after
            if not front:
                break
        gs, hs = (np.bincount(node, v, len(out)) for v in (g, h))
        for k in np.unique(node):
            out[k][4] = rate * gs[k] / (hs[k] + smooth)
        f += np.array([r[4] for r in out])[node]
    a = np.array(out).T
    whole = lambda v: v.astype(np.int64)
    return Trees(whole(a[0]), a[1], whole(a[2]), whole(a[3]), a[4], np.array(roots), depth, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch, "text"):
            part = batch.slice(lo, hi - lo)
            x = np.array([statistics(t or b"") for t in part.column("text").to_pylist()], np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<float>)`` per row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(_features, f"doc_id {kind}, x array<float>"))


def fit(featured: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees | None:
    """Boosted trees from about ``sample`` distinct labelled rows that are not held out.

    Rows with the same features and label are one row with their number as weight,
    so a hot group of copies neither crowds out the others nor is cut.  Rows
    are drawn by a hash of their features, so the draw is the same whatever
    the partitioning.  Rows without a label, or with a null one, are left out; an
    id with several labels counts as their majority.  None without a label.
    """
    label = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    rows = featured.where(~held_out()).join(label, "doc_id").select("x", "y")
    rows = saved(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "quality-labelled")
    count = rows.count()
    draw = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.where(draw * count < sample).orderBy("x", "y").toArrow()
    if not got.num_rows:
        return None
    return boost(np.array(got.column("x").to_pylist(), np.float64), got.column("y").to_numpy().astype(np.float64),
                 got.column("n").to_numpy().astype(np.float64))


def score(featured: DataFrame, model: Trees | None) -> DataFrame:
    """``(doc_id, score)``: probability that quality is 1 (0.5 without a model)."""
    if model is None:
        return featured.select("doc_id", F.lit(0.5).alias("score"))
    shared = featured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))],
                                             ["doc_id", "score"])

    return featured.mapInArrow(run, f"doc_id {featured.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``.

    Null and empty texts are scored like any other, from zero statistics.  Repeated
    rows are returned as often as they come; further columns are ignored; an empty
    table gives an empty result, and without labels every score is 0.5.
    """
    featured = saved(features(docs), "quality-features")
    return score(featured, fit(featured, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
