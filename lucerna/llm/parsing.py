"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points.  A level of parsing turns a sequence of names
into a shorter one:

1. a run of equal names becomes one name, so that neighbours differ;
2. deterministic coin tossing colours the sequence: a name is replaced by twice the
   lowest bit in which it differs from its left neighbour, plus that bit.  Neighbours
   still differ, and four rounds bring 64 bits down to six colours; colours 5, 4
   and 3 then take the smallest of 0, 1, 2 that neither neighbour has;
3. a phrase begins at every local maximum of the colours, two to four names apart,
   and its name is a hash of the names in it.

The choice of borders looks at four names to the left and a few to the right only,
so a substring gets the same phrases wherever it stands, but for a few at its
ends, on every level.  Levels go on until one name, the root, is left.

The fingerprint is the root and a sketch of all phrases of all levels: weighted
minwise hashing in BINS bins, every copy of a phrase weighing as many code points as
it holds, up to GRAIN.  Two fingerprints' likeness is the share of agreeing bins, which
estimates the shared weight of phrases over the weight of either.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import text_slices

BINS = 128  # one byte of the fingerprint each
GRAIN = 64  # code points from which on a longer phrase weighs no more
PIECE = 1 << 20  # code points parsed at a time (a longer text is a piece of its own)
SAMPLED = 20  # sampled keys for every border between buckets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash of every number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowest_difference(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit of two arrays, plus that bit of ``now``."""
    differ = now ^ before
    lowest = differ & (~differ + now.dtype.type(1))
    bit = np.bitwise_count(lowest - now.dtype.type(1))
    return 2 * bit + ((now & lowest) != 0).view(np.uint8)


def _shifted(x: np.ndarray, by: int, edge: np.ndarray, value) -> np.ndarray:
    """The left (by = 1) or right (-1) neighbour of every place, ``value`` where there is none."""
    out = np.empty_like(x)
    if by > 0:
        out[1:] = x[:-1]
    else:
        out[:-1] = x[1:]
    out[edge] = value
    return out


def colours(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Colours 0, 1 and 2 of sequences without equal neighbours; ``first`` holds the places where sequences begin."""
    last = np.append(first[1:], len(names)) - 1
    colour = names
    for _ in range(4):  # a first name differs from nothing: its lowest bit counts
        colour = _lowest_difference(colour, _shifted(colour, 1, first, colour[first] ^ colour.dtype.type(1)))
    for high in (5, 4, 3):
        a, b = _shifted(colour, 1, first, 9), _shifted(colour, -1, last, 9)
        zero = ((a == 0) | (b == 0)).view(np.uint8)  # 0 is taken
        one = ((a == 1) | (b == 1)).view(np.uint8)
        colour = colour - (colour == high) * (np.uint8(high) - zero * (one + np.uint8(1)))
    return colour


def phrases(names: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level: names of the phrases, places where sequences begin, and where phrases begin among the code points.

    ``first`` and ``at`` are the same of the names given; ``at`` has the end as one more entry.
    """
    # runs of equal names
    begins = np.empty(len(names), bool)
    begins[0] = True
    np.not_equal(names[1:], names[:-1], out=begins[1:])
    begins[first] = True
    starts = np.flatnonzero(begins)
    if len(starts) < len(names):
        run = np.diff(np.append(starts, len(names)))
        first = np.searchsorted(starts, first)
        names, at = names[starts].astype(np.uint64), np.append(at[starts], at[-1])
        many = np.flatnonzero(run > 1)
        names[many] = mix(names[many] * np.uint64(5) + run[many].astype(np.uint64))
        clash = np.setdiff1d(np.flatnonzero(names[1:] == names[:-1]) + 1, first)  # a run's new name like its neighbour's, by chance
        names[clash] = mix(names[clash])
    colour = colours(names, first)
    last = np.append(first[1:], len(names)) - 1
    # colours count from 1, so that 0 stands beyond both ends
    colour = colour + np.uint8(1)
    begins = (colour > _shifted(colour, 1, first, 0)) & (colour > _shifted(colour, -1, last, 0))
    begins[first] = True
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, len(names))).astype(np.uint8)  # at most 4, or 5 at the beginning
    names = names.astype(np.uint64, copy=False)
    out = mix(names[starts] * np.uint64(3) + size)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] = mix(out[more] * np.uint64(3) + names[starts[more] + k])
    return out, np.searchsorted(starts, first), np.append(at[starts], at[-1])


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts: rows of 8 root bytes and BINS sketch bytes; zeros for an empty text."""
    out = np.zeros((len(texts), 8 + BINS), np.uint8)
    size = np.array([len(t) for t in texts])
    if not size.sum():
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.flatnonzero(size)
    first = np.cumsum(size[owner]) - size[owner]
    at = np.arange(len(names) + 1)
    best = np.full(len(texts) * BINS, np.inf)
    held = np.zeros(len(texts) * BINS, np.uint8)
    roots = np.zeros(len(texts), np.uint64)
    while len(names):
        names, first, at = phrases(names, first, at)
        counts = np.diff(np.append(first, len(names)))
        length = np.diff(at)
        # the copies of a phrase within a text are numbered and count one by one
        sequence = np.repeat(owner, counts)
        key = mix(names + mix(sequence.astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        copy = np.empty(len(key), np.uint64)
        copy[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        name = mix(names + copy * np.uint64(0x9E3779B97F4A7C15))
        slot = sequence * BINS + (name & np.uint64(BINS - 1)).astype(np.int64)
        draw = ((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        score = -np.log(draw) / np.minimum(length, GRAIN)
        np.minimum.at(best, slot, score)
        won = np.flatnonzero(score == best[slot])
        held[slot[won]] = (mix(name[won]) & np.uint64(255)).astype(np.uint8)
        # sequences of one name are parsed to the end
        single = counts == 1
        roots[owner[single]] = names[first[single]]
        if single.any():
            stay = ~np.repeat(single, counts)
            names, at = names[stay], np.concatenate([[0], np.cumsum(length[stay])])
            owner, counts = owner[~single], counts[~single]
            first = np.cumsum(counts) - counts
    # an empty bin takes its value from the next filled one, changed by the distance
    filled = np.isfinite(best).reshape(len(texts), BINS)
    held = held.reshape(len(texts), BINS)
    place = np.where(np.concatenate([filled, filled], 1), np.arange(2 * BINS), 4 * BINS)
    source = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    some = size > 0
    distance = source - np.arange(BINS)
    value = np.take_along_axis(held, source % BINS, 1) + (distance * 37).astype(np.uint8)
    out[some, 8:] = value[some]
    out[:, :8] = roots.astype(">u8")[:, None].view(np.uint8).reshape(len(texts), 8)
    out[~some] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints row by row: 1 with equal roots, 0 if one text only is empty."""
    same = (a[:, 8:] == b[:, 8:]).mean(1)
    estimate = np.maximum(0.0, (same - 1 / 256) / (1 - 1 / 256))  # bins agree by chance in one of 256
    one_empty = a.any(1) != b.any(1)
    return np.where((a[:, :8] == b[:, :8]).all(1), 1.0, np.where(one_empty, 0.0, estimate))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (hex digits of the root and of the bins) of the text; a null text is an empty one."""
    rest = [c for c in docs.columns if c.lower() not in ("text", "fingerprint")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                marks = fingerprints([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array([m.tobytes().hex() for m in marks], pa.string())],
                                                 [*rest, "fingerprint"])
    return docs.select(*rest, "text").mapInArrow(run, (kinds + ", " if kinds else "") + "fingerprint string")


# ---- every document beside the next one

def _key(doc_id, mark: int) -> tuple:
    """Ascending doc_id, null last, then by the text's hash."""
    return (doc_id is None, 0 if doc_id is None else doc_id, mark)


def _borders(keys: DataFrame, buckets: int) -> list[tuple]:
    """Sampled keys that cut the order of rows into about ``buckets`` even ranges."""
    rows = keys.count()
    every = max(1, rows // (buckets * SAMPLED))
    drawn = sorted({_key(*r) for r in keys.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(every)) == 0).distinct().collect()})
    return sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []


def _firsts(borders: list[tuple]):
    """The smallest key of every bucket among a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                key = _key(*row)
                b = bisect_right(borders, key)
                if b not in least or key < least[b]:
                    least[b] = key
        for b, key in least.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([None if key[0] else key[1]], batch.schema.field("doc_id").type),
                                              pa.array([key[2]], pa.int64())], ["bucket", "doc_id", "mark"])
    return run


def _deal(borders: list[tuple], ghosts: dict[tuple, list[int]]):
    """Rows with their bucket; a bucket's first row goes to the bucket before as well.  Copies within a batch become one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(*r) for r in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)]
            texts, seen = batch.column("text"), {}
            for i, key in enumerate(keys):
                if key in seen and any(texts[j].equals(texts[i]) for j in seen[key]):
                    j = next(j for j in seen[key] if texts[j].equals(texts[i]))
                    seen[key][j] += 1
                else:
                    seen.setdefault(key, {})[i] = 1
            rows = [(bisect_right(borders, key), 0, i, n) for key, at in seen.items() for i, n in at.items()]
            rows += [(b, 1, i, 0) for key, at in seen.items() for b in ghosts.get(key, ()) for i in at]
            take = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), batch.column("doc_id").take(take),
                 batch.column("mark").take(take), texts.take(take), pa.array([r[3] for r in rows], pa.int64())],
                ["bucket", "ghost", "doc_id", "mark", "text", "copies"])
    return run


def edited_text(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order: each document of a bucket beside the next one, the last beside the ghost."""
    held: list[list] = []  # [bucket, ghost, doc_id, text, copies]; the last one waits for the document after it

    def emit(rows: list[list], after: list | None) -> pa.RecordBatch:
        texts = [r[3] for r in rows] + ([after[3]] if after is not None else [])
        follows = [texts[i + 1] if i + 1 < len(texts) else texts[i] for i in range(len(rows))]
        own = fingerprints(texts)
        changed = [edited_text(t, f) for t, f in zip(texts, follows, strict=False)]
        marks = fingerprints(changed)
        n, of = len(rows), np.minimum(np.arange(1, len(rows) + 1), len(texts) - 1)
        near, beside = likeness(own[:n], marks), likeness(own[:n], own[of])
        at = [i for i, r in enumerate(rows) for _ in range(r[4])]
        pick = lambda values: [values[i] for i in at]
        return pa.RecordBatch.from_arrays(
            [pa.array(pick([r[2] for r in rows]), kind[0]), pa.array(pick([len(r[3]) for r in rows]), pa.int64()),
             pa.array(pick([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.string()),
             pa.array(pick([m.tobytes().hex() for m in own[:n]]), pa.string()), pa.array(pick([m.tobytes().hex() for m in marks]), pa.string()),
             pa.array(pick(near.tolist()), pa.float64()), pa.array(pick(beside.tolist()), pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind: list = []
    size = 0
    for batch in batches:
        kind = [batch.schema.field("doc_id").type]
        for lo, hi in text_slices(batch, "text"):
            part = batch.slice(lo, hi - lo).to_pydict()
            for row in zip(part["bucket"], part["ghost"], part["doc_id"], part["text"], part["copies"], strict=True):
                last = held[-1] if held else None
                if last and last[0] == row[0] and last[1] == row[1] and last[2:4] == list(row[2:4]):
                    last[4] += row[4]
                    continue
                if last and last[0] != row[0]:  # a new bucket; a ghost ends the one before
                    if rest := [r for r in held if not r[1]]:
                        yield emit(rest, last if last[1] else None)
                    held, size = [], 0
                elif size > PIECE and not last[1]:
                    if held[:-1]:
                        yield emit(held[:-1], last)
                    held, size = [last], len(last[3])
                if last and held and held[-1][1]:
                    continue  # one ghost is enough
                held.append(list(row))
                size += len(row[3])
    if rest := [r for r in held if not r[1]]:
        yield emit(rest, held[-1] if held[-1][1] else None)


def _buckets(spark: SparkSession, docs: DataFrame) -> int:
    """Four ranges a task of the scan or of a shuffle, whichever has more."""
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text, and their likeness.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``.  The next document is the one after it by ascending doc_id (null
    last, after the last the first; rows of one doc_id by a hash of their text).
    Repeated rows (same id and text) are one document that is returned as often
    as it comes; a document without another one is its own next.  A null text is
    an empty one: its fingerprint is zero, like itself (1) and unlike any other (0).
    Texts are never cut: one of any length is parsed in one piece, in some 60 bytes of
    memory a code point.  An empty table gives no rows; other columns are ignored.

    Whole texts are shuffled once, into ranges of (doc_id, text hash) cut at sampled
    keys, so many rows of one id are spread; copies meet as one row per batch.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    buckets = _buckets(spark, docs)
    borders = _borders(rows.select("doc_id", "mark"), buckets)
    first = (rows.select("doc_id", "mark").mapInArrow(_firsts(borders), f"bucket long, doc_id {kind}, mark long")
             .groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k"))
             .orderBy("bucket").collect())  # one key a bucket
    ghosts: dict[tuple, list[int]] = {}
    for i, r in enumerate(first):
        ghosts.setdefault(_key(r["k"]["doc_id"], r["k"]["mark"]), []).append(first[i - 1]["bucket"])
    dealt = rows.select("doc_id", "mark", "text").mapInArrow(
        _deal(borders, ghosts), f"bucket long, ghost long, doc_id {kind}, mark long, text string, copies long")
    ordered = (dealt.repartition(buckets, "bucket")
               .sortWithinPartitions("bucket", "ghost", F.col("doc_id").isNull(), "doc_id", "mark", "text"))
    return ordered.select("bucket", "ghost", "doc_id", "text", "copies").mapInArrow(
        _compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
