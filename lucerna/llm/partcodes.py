"""Vector code compression: codebooks of vector parts, searched by equal averages.

A vector of whole numbers is cut into consecutive parts, and every part is stored
as the index of its nearest codebook entry.  The search for that entry sorts the
entries by the sum of their components.  By the Cauchy-Schwarz inequality two
parts of d components whose sums differ by g are at least g^2 / d apart (squared),
so the search starts at the entry whose sum is next to the part's and expands to
both sides until g^2 / d is strictly above the best squared distance: at equality
an entry of a lower index could still tie.

Codebooks are fitted by rounds of assignment and componentwise mean over all rows.
A task adds up its parts per entry and Spark adds the tasks' sums; only one codebook
(parts x entries x components) meets in the driver.  All arithmetic is in whole
numbers, so the result does not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import saved
from lucerna.llm.vectors import matrix, whole_vectors

FEW_LABELS = 10_000  # label sums up to this many rows are broadcast, more are joined by a shuffle


def borders(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector lie; equal if ``parts`` divides ``dim``, else as equal as can be."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def component_limit(dim: int, parts: int) -> int:
    """The largest component for which every distance and squared sum gap stays below 2^62."""
    widest = max((hi - lo for lo, hi in borders(dim, parts)), default=1)
    return isqrt(2 ** 62 // max(dim, widest * widest, 1)) // 2


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row (ties to the lower) and the squared distance."""
    n, d = rows.shape
    index, best = np.zeros(n, np.int64), np.full(n, 2 ** 62 // max(d, 1))
    if not d:
        return index, np.zeros(n, np.int64)
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = rows.sum(1)
    up = np.searchsorted(sums, own)
    down = up - 1
    far = np.int64(2 ** 31 * d)  # beyond any gap; its square is never formed
    left = np.arange(n)
    while len(left):
        a, b = down[left], up[left]
        below = np.where(a >= 0, own[left] - sums[a], far)
        above = np.where(b < len(book), sums[np.minimum(b, len(book) - 1)] - own[left], far)
        gap = np.minimum(below, above)
        go = gap < far
        go[go] = gap[go] ** 2 <= best[left[go]] * d
        left, lower, a, b = left[go], (below <= above)[go], a[go], b[go]
        entry = order[np.where(lower, a, b)]
        down[left[lower]] -= 1
        up[left[~lower]] += 1
        gap = rows[left] - book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        better = (distance < best[left]) | ((distance == best[left]) & (entry < index[left]))
        index[left[better]], best[left[better]] = entry[better], distance[better]
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """One codebook (entries x components) for every part position."""

    dim: int
    books: tuple[np.ndarray, ...]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry index and squared distance of every part (rows x parts)."""
        found = [nearest(np.ascontiguousarray(x[:, lo:hi]), book)
                 for (lo, hi), book in zip(borders(self.dim, len(self.books)), self.books, strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The whole-number vectors that codes (rows x parts) stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)

    def sha256(self) -> str:
        text = ",".join(str(v) for book in self.books for v in book.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def _part_sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.books]  # the last column counts
        for batch in batches:
            x = matrix(batch, books.dim)
            codes, _ = books.assign(x)
            for p, (lo, hi) in enumerate(borders(books.dim, len(totals))):
                np.add.at(totals[p], codes[:, p], np.concatenate([x[:, lo:hi], np.ones((len(x), 1), np.int64)], 1))
        for p, total in enumerate(totals):
            entry, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(total[entry, place])],
                ["part", "entry", "place", "total"])
    return run


def fit_codebooks(vectors: DataFrame, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks over all rows of ``vectors(vec_id, x)``; the first are the parts of the smallest ids."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), dim)
    books = Codebooks(dim, tuple(start[:, lo:hi].copy() for lo, hi in borders(dim, parts)))
    for _ in range(rounds if first else 0):
        sums = (vectors.select("x").mapInArrow(_part_sums(books), "part long, entry long, place long, total long")
                .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect())
        moved = [np.zeros((len(b), b.shape[1] + 1), object) for b in books.books]
        for part, entry, place, total in sums:
            moved[part][entry, place] = total
        books = Codebooks(dim, tuple(
            np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(new, book, strict=True)],
                     np.int64).reshape(book.shape) for new, book in zip(moved, books.books, strict=True)))
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, codes array<int>, error)`` of every row of ``vectors(vec_id, label, x)``."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distance = books.assign(matrix(batch, books.dim))
            flat = pa.array(codes.astype(np.int32).ravel())
            ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(ends, flat), pa.array(distance.sum(1))],
                ["vec_id", "label", "codes", "error"])
    return vectors.select("vec_id", "label", "x").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6,
             scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """Codes of ``embeddings(vec_id, embedding, label)`` and the codebooks they refer to.

    ``(vec_id, label, codes, error, label_error)``: one row per kept row, repeated
    rows as often as they come; ``error`` is the sum of the parts' squared
    distances, ``label_error`` its sum over all rows with the same label (null
    labels together).  Rows whose vector is null, empty or holds a null, NaN or
    infinite component, or is of another length than the commonest one, are left
    out; components of more than ``component_limit`` after scaling count as that
    limit (|c| of some 32,000 at 64 components).  A null id sorts last; equal ids
    start the codebooks in the order of their vectors.  With fewer rows than entries
    the codebooks are smaller; an empty table gives no rows and empty codebooks.
    Other columns are ignored.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding"))
    widest = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    vectors, dim = whole_vectors(rows, "embedding", scale, 0, component_limit(max(widest, 1), parts), "codes-x")
    books = fit_codebooks(vectors, dim, parts, entries, rounds)
    coded = saved(encode(vectors, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = saved(sums, "codes-labels")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), books


def report(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` with 8 parts, 16 entries and 6 rounds.

    ``code`` holds two hex digits a part.  A label's error beyond 64 bits is null.
    """
    coded, books = compress(embeddings)
    digits = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.select("vec_id", digits.alias("code"), "error", F.expr("try_cast(label_error AS bigint)").alias("label_error"),
                        F.lit(books.sha256()).alias("codebooks_sha256"))
