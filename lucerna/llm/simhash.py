"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 23, 23 and 18 bits.  The
binary Golay code of length 23 is perfect: every 23-bit word lies within three
bits of exactly one codeword.  A segment's *keys* are the codeword it decodes to
and the codewords its one-bit neighbours decode to (one key for words near their
codeword, six for those at distance three).

Three differing bits over three segments leave a pair of segments with at most
one differing bit each (pigeonhole).  For every pair of segments a fingerprint
is listed under (any key of one, own codeword of the other) and the reverse.  If
u and v differ by at most one bit in both segments, u has v's codeword among its
keys in the first and v has u's in the second, so both are listed under
(codeword of v, codeword of u).  No link is lost, with about 29 keys of 24 bits
per fingerprint instead of 84.

Fingerprints are collapsed to distinct values first, so copies cost one row.
Each bucket verifies its members by bit count and emits a spanning forest (one
row per member at most), never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import connected_components, fresh_name, saved

# Generator polynomial of the binary Golay code and the segments.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_DISTANCE = 3
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of UTF-8 bytes: A-Z lower-cased, ASCII white space splits words.

    Every shingle counts as often as it occurs.  A text with fewer words than a
    shingle has one shingle, its whole word sequence; without words it is zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return int(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    ones, total = np.zeros(64, np.int64), len(words) - shingle + 1
    digest, step = xxhash.xxh64_intdigest, 1 << 16
    for at in range(0, total, step):
        part = words[at:at + step + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


class Golay:
    """Nearest-codeword decoding of 23-bit words through a syndrome table."""

    def __init__(self) -> None:
        rest = []
        for i in range(23):
            r = 1 << i
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= GENERATOR << (bit - 11)
            rest.append(r)
        self.low, self.high = self._linear(rest[:12]), self._linear(rest[12:])
        self.error = np.zeros(2048, np.int64)
        for weight in (1, 2, 3):
            for where in combinations(range(23), weight):
                s = 0
                for i in where:
                    s ^= rest[i]
                self.error[s] = sum(1 << i for i in where)

    @staticmethod
    def _linear(images: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for image in images:
            out = np.concatenate([out, out ^ image])
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Own codeword index (n,) and the other indices one flip away (n, bits), -1 where repeated."""
        own = self.index(words)
        other = np.sort(self.index(words[:, None] ^ (1 << np.arange(bits, dtype=np.int64))), axis=1)
        other[:, 1:][other[:, 1:] == other[:, :-1]] = -1
        other[other == own[:, None]] = -1
        return own, other


def bucket_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fps``) rows of all fingerprints."""
    segment = [golay.keys(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64), n)
               for at, n in SEGMENTS]
    keys, rows = [], []
    here = np.arange(len(fps))
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (own_i, more_i), (own_j, more_j) = segment[i], segment[j]
        keys.append(p << 24 | own_i << 12 | own_j)
        rows.append(here)
        for more, fixed, left in ((more_i, own_j, True), (more_j, own_i, False)):
            r, c = np.nonzero(more >= 0)
            k = more[r, c]
            keys.append(p << 24 | (k << 12 | fixed[r] if left else fixed[r] << 12 | k))
            rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at:at + 4096]
            keys, rows = bucket_keys(part.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of n items' component under the links a-b."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MAX_DISTANCE


def run_forest(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per item the smallest position linked to it inside its run (runs are disjoint)."""
    label = np.arange(len(fps))
    small = sizes <= 64
    own = np.repeat(np.arange(len(sizes)), sizes)
    ok = np.repeat(small, sizes)
    longest = int(sizes[small].max(initial=1))
    left, right = [], []
    for d in range(1, longest):
        i = np.flatnonzero((own[:-d] == own[d:]) & ok[:-d])
        if not len(i):
            break
        i = i[_near(fps[i], fps[i + d])]
        left.append(i)
        right.append(i + d)
    if left:
        label = _components(len(fps), np.concatenate(left), np.concatenate(right), label)
    for at, n in zip(starts[~small], sizes[~small], strict=True):
        part = fps[at:at + n]
        got = np.arange(n)
        # two fingerprints three bits apart agree on one of four 16-bit blocks: compare only those
        for block in range(4):
            value = (part >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for members in np.split(order, cuts):
                for row in range(0, len(members), 512):
                    m = members[row:row + 512]
                    rest = members[row:]
                    i, j = np.nonzero(_near(part[m][:, None], part[rest][None, :]))
                    if len(i) > len(m):
                        got = _components(n, m[i], rest[j], got)
        label[at:at + n] = at + got
    return label


def _emit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a run of one key is handled once it is complete."""
    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        several = sizes > 1
        take = np.repeat(several, sizes)
        fps, sizes = fps[take], sizes[several]
        starts = np.cumsum(sizes) - sizes
        label = run_forest(fps.view(np.uint64), starts, sizes)
        child = np.flatnonzero(label != np.arange(len(fps)))
        pairs = np.unique(np.stack([fps[child], fps[label[child]]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        if held and keys[0] == keys[-1] == held[-1][0][-1]:
            held.append((keys, fps))
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        done = [*held, (keys[:cut], fps[:cut])]
        held = [(keys[cut:], fps[cut:])]
        if cut == 0 and len(done) > 1 and done[-2][0][-1] == keys[0]:
            held = [*done[:-1], *held]
            continue
        k, f = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        if len(k):
            yield links(k, f)
    if held:
        yield links(*(np.concatenate([d[i] for d in held]) for i in (0, 1)))


def _emit_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return run


def _emit_row_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps.view(np.int64))],
                                             ["doc_id", "row", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_emit_fingerprints(shingle), "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints at most three bits apart."""
    keyed = fps.select("fp").distinct().mapInArrow(_emit_keys, "key int, fp long")
    return (keyed.repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(_emit_links, "a long, b long").distinct())


def _components_of(fps: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` per distinct fingerprint of ``fps(doc_id, fp)``."""
    roots = connected_components(links(fps), "simhash-components")
    first = (fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
             .join(roots, F.col("fp") == F.col("node"), "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    first = saved(first, "simhash-groups")
    return first.join(first.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most three bits; the
    component id is the smallest doc_id reachable.  Null and empty texts have
    fingerprint zero and link like any other.  Rows with a null doc_id are kept
    and join their component, but never name it unless all its ids are null.
    Repeated rows are returned as often as they come; other columns are ignored;
    an empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, shingle), "simhash-fps")
    return fps.join(_components_of(fps).drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` (all columns) per near-duplicate component.

    It is the one with the smallest doc_id (null ids last), of those the one with
    the smallest hash of all its columns; of rows equal in every column one stays.
    """
    row, doc = fresh_name("row_hash", docs.columns), F.col("doc_id").cast("long")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(row, F.xxhash64(*plain))
    with_row = marked.select(doc.alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col(row).alias("row"))
    fps = saved(with_row.mapInArrow(_emit_row_fingerprints(shingle), "doc_id long, row long, fp long"), "simhash-fps")
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("row"))
    best = (fps.join(_components_of(fps.select("doc_id", "fp")), "fp").withColumn("r", rank)
            .groupBy("root", "r").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("root").agg(F.min(F.struct("r", "n")).alias("b"))
            .select(F.col("b.r.d").alias("d"), F.col("b.r.row").alias("row"), (F.col("b.n") > 1).alias("several")))
    best = saved(best, "simhash-kept")
    kept = marked.join(best, (F.coalesce(doc, F.lit((1 << 63) - 1)) == best["d"]) & (F.col(row) == best["row"]))
    kept = kept.select(*marked.columns, best["several"])
    return (kept.where(~best["several"]).select(*docs.columns)
            .unionByName(kept.where(best["several"]).dropDuplicates(["doc_id", row]).select(*docs.columns)))
