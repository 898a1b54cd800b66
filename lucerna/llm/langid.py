"""Language identification by a blended-spectrum string kernel.

A text is the set of its letter n-grams of length 1 to 3 (lower case, runs of
other characters are one blank, letters folded into 64 classes).  The kernel of
two texts is the size of the intersection over the geometric mean of their
sizes.  Landmark texts per language give a Nyström feature map; one-versus-rest
kernel ridge regression on it is a small matrix, and scoring is a product of the
presence matrix of a batch with the landmark matrix, then with the weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.common import fresh_name, held_out, saved, text_slices

LONGEST = 3
SPACE = 64 + 64 ** 2 + 64 ** 3
UNKNOWN = "und"


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """0 for characters that are no letters, 1-26 for a-z, 27-62 for other letters."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(128, 0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = 27 + cp % 36
    out[ord("a"):ord("z") + 1] = 1 + np.arange(26)
    return out


def ngram_set(text: str) -> np.ndarray:
    """Sorted feature numbers of the text's n-grams; empty without letters."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_classes()[cps]
    if not c.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    present = np.zeros(SPACE, bool)
    present[c[c > 0]] = True
    pair = c[:-1] << 6 | c[1:]
    present[64 + pair] = True
    present[64 + 4096 + (pair[:-1] << 6 | c[2:])] = True
    return np.flatnonzero(present)


@dataclass
class StringKernel:
    """Landmark n-gram sets, ready for batched products."""

    row: np.ndarray  # position of a feature among those of the landmarks, -1 elsewhere
    matrix: np.ndarray  # features x landmarks, presence over the root of the landmark's size

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> StringKernel:
        used = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.int64)
        row = np.full(SPACE, -1, np.int32)
        row[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(sets)), np.float32)
        for j, s in enumerate(sets):
            matrix[row[s], j] = 1 / np.sqrt(len(s))
        return cls(row, matrix)

    def against(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of the given sets with all landmarks."""
        x = np.zeros((len(sets), len(self.matrix)), np.float32)
        for i, s in enumerate(sets):
            if len(s):
                at = self.row[s]
                x[i, at[at >= 0]] = 1 / np.sqrt(len(s))
        return x @ self.matrix


@dataclass
class Model:
    kernel: StringKernel
    weights: np.ndarray  # landmarks x languages
    langs: list[str]


def _rows(batches: Iterator[pa.RecordBatch], kernel: StringKernel) -> Iterator[tuple]:
    """(rows of a batch, sizes of their n-gram sets, kernel values), 128 texts at a time."""
    for batch in batches:
        for lo, hi in text_slices(batch, "text"):
            for at in range(lo, hi, 128):
                part = batch.slice(at, min(128, hi - at))
                sets = [ngram_set(t or "") for t in part.column("text").to_pylist()]
                yield part, np.array([len(s) for s in sets]), kernel.against(sets)


def _landmark_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [ngram_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["s"])


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` distinct training texts of each language, by text hash.

    The hash threshold comes from counts of distinct text hashes, so copies do
    not thin out a language's other texts; only hashes and about the sample are
    shuffled, and no language passes through one task whole.
    """
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # written first: a small table is then broadcast from the start, and the texts are not dealt out by language
    texts = train.select("lang", F.xxhash64("text").alias("h")).distinct()
    size = saved(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")
    draw = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    picked = (train.select("text", "lang", draw).join(size, "lang")
              .where(F.col("u") * F.col("n") < 2.0 * per_language + 20).dropDuplicates(["lang", "text"]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text"), "text"))
    return picked.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang", "rank")


def fit(docs: DataFrame, per_language: int = 800, landmarks: int = 256, ridge: float = 1e-2) -> Model | None:
    """Fit on a bounded sample (``per_language`` texts) of the rows not held out.

    ``landmarks`` of them, spread evenly over the languages (one each at least),
    define the feature map.  None without any labelled text that has letters.
    """
    sample = saved(labelled_sample(docs.select("doc_id", "text", "lang"), per_language), "langid-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    each = max(1, landmarks // max(1, len(langs)))
    marks = sample.where(F.col("rank") <= each).select("text").mapInArrow(_landmark_sets, "s array<long>")
    sets = [s for s in map(np.asarray, marks.toArrow().column("s").to_pylist()) if len(s)]
    if not sets:
        return None
    sets.sort(key=lambda s: (len(s), s.tolist()))
    kernel = StringKernel.of(sets)
    shared = sample.sparkSession.sparkContext.broadcast(kernel)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, k in _rows(batches, shared.value):
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(k), pa.list_(pa.float32()))],
                                             ["lang", "k"])

    rows = sample.select("text", "lang").mapInArrow(features, "lang string, k array<float>").toArrow()
    k = np.array(rows.column("k").to_pylist(), np.float64)
    y = (np.array(rows.column("lang").to_pylist())[:, None] == np.array(langs)[None, :]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel.against(sets).astype(np.float64))
    good = value > value.max() * 1e-7
    to_features = vector[:, good] / np.sqrt(value[good])
    phi = k @ to_features
    balance = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)][:, None] * len(y) / len(langs)
    beta = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]), phi.T @ (y * balance))
    return Model(kernel, (to_features @ beta).astype(np.float32), langs)


def _predict(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.langs, UNKNOWN], object)
        for part, sizes, k in _rows(batches, m.kernel):
            s = k @ m.weights
            best = np.where(sizes > 0, s.argmax(1), len(m.langs))
            score = np.where(sizes > 0, np.clip(s.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))],
                [f"c{i}" for i in range(part.num_columns)] + ["lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) appended, from the text alone.

    A null text, or one without letters, is ``und`` with score 0, and so is every
    text if there is no model.  Rows are independent of each other.
    """
    if model is None:
        return docs.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (b.rename_columns([*plain[:at], "text", *plain[at + 1:]]) for b in batches)
        yield from _predict(shared)(named)

    return docs.mapInArrow(run, schema).toDF(*docs.columns, pred_col, score_col)


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose language is recognised with a score of ``least`` or more.

    Rejected are ``und`` (null and letterless texts) and texts unlike every
    learned language.  Other nulls, repeats and further columns change nothing.
    """
    pred, score = fresh_name("lang_pred", docs.columns), fresh_name("score", docs.columns)
    out = predict(docs, fit(docs), pred, score)
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``docs(doc_id, text, lang)``.

    Learns from the rows that are not held out and have a language.  Null and
    letterless texts are ``und``; a null doc_id counts as held out; repeated rows
    are returned as often as they come; further columns are ignored; an empty
    table gives an empty result.
    """
    return (predict(docs.select("doc_id", "text"), fit(docs))
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
