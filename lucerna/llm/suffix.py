"""Removal of long repeated byte strings by sorting sampled suffixes.

A window of ``length`` bytes is repeated if it also starts anywhere else.  Sorting
every suffix of 100 TB is out of reach, so suffixes are sampled in a way that
loses nothing: each window names one suffix, the one that starts at the smallest
hash among the ``GRAM``-byte strings inside it (the leftmost of equals).  Equal
windows name the same place, so two windows are equal only if their suffixes
share the leading GRAM bytes.  About 1.2 % of the suffixes are named.

1. Named suffixes with their leading-token hash and the hash of their whole
   context (all windows that name them) are counted in Spark.  Those whose
   leading tokens occur once are done: nothing there is repeated.  Where a whole
   context occurs twice, all its windows are repeated.
2. What is left are suffixes at the borders of repeats.  They are range
   partitioned by their leading tokens (Spark samples the splitters).  Each bucket
   sorts its suffixes, and the reversed contexts to their left, by multikey
   quicksort; common prefixes of neighbours give, for every window, the classes
   of equal right and left parts, and a window is repeated if its pair of classes
   occurs twice.  A splitter never falls inside a run of equal leading tokens:
   suffixes on the two sides of a border differ within them, so no window can be
   equal across it.
3. Leading tokens with very many different contexts (the edges of a passage that
   a large share of all documents hold) would fill one bucket.  Their windows are
   counted one by one with partial sums instead, which spreads over all tasks.

Copies of a whole text need none of this: each is removed from end to end, and
one copy per task stands for it as a partner of other texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import fresh_name, saved, text_slices

LENGTH = 200
GRAM = 40
BUFFER = 1 << 18  # bytes hashed at a time
HEAVY = 50_000  # contexts of one leading string beyond which windows are counted one by one
SEEN = 100_000  # text keys remembered per task

BASE = 0x9E3779B97F4A7C15 | 1
PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Tables:
    """Powers of the rolling hash and a random value per byte, made once per worker."""

    made: _Tables | None = None

    def __init__(self) -> None:
        n = BUFFER * 2 + 2 * LENGTH + 2
        self.power, self.inverse = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        self.byte = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)

    @classmethod
    def get(cls) -> _Tables:
        if cls.made is None:
            cls.made = cls()
        return cls.made


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def named_suffixes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> dict:
    """Suffixes named by the windows of the pieces ``data[start:start + size]``.

    ``p``: their places; ``first``, ``last``: first and last window that names each;
    ``anchor``, ``context``: hashes of the leading tokens and of all those windows.
    """
    t = _Tables.get()
    ok = sizes >= length
    starts, counts = starts[ok], sizes[ok] - length + 1
    if not len(starts):
        e = np.empty(0, np.int64)
        return {"p": e, "first": e, "last": e, "anchor": e, "context": e}
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(t.byte[data] * t.power[:n], out=prefix[1:])
    anchor = _mix((prefix[gram:] - prefix[:-gram]) * t.inverse[:n - gram + 1])
    value = (anchor & ~PLACE) | np.arange(len(anchor), dtype=np.uint64)
    wide = length - gram + 1
    padded = np.full(-(-len(value) // wide) * wide, np.uint64((1 << 64) - 1))
    padded[:len(value)] = value
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    p = (np.minimum(behind[windows], ahead[windows + wide - 1]) & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    p = p[new]
    whole = (prefix[last + length] - prefix[first]) * t.inverse[first]
    shape = _mix(((p - first) * 65536 + (last - first)).astype(np.uint64))
    return {"p": p, "first": first, "last": last, "anchor": anchor[p].view(np.int64), "context": _mix(whole + shape).view(np.int64)}


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Buffers of whole texts (long ones in overlapping pieces), each text once per task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys, sizes = (batch.column(i).to_pylist() for i in (0, 1))
        for lo, hi in text_slices(batch, "text", BUFFER):
            rows, offsets, parts = [], [], []
            for i in range(lo, hi):
                k = (keys[i], sizes[i])
                if sizes[i] < length or k in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                text = batch.column("text")[i].as_py()
                for at in range(0, max(1, len(text) - length + 1), BUFFER):
                    rows.append(k)
                    offsets.append(at)
                    parts.append(text[at:at + BUFFER + length - 1])
                    if len(text) > BUFFER:
                        yield rows, offsets, parts
                        rows, offsets, parts = [], [], []
            if parts:
                yield rows, offsets, parts


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, parts in _pieces(batches, length):
            data = np.frombuffer(b"".join(parts), np.uint8)
            sizes = np.array([len(x) for x in parts])
            starts = np.cumsum(sizes) - sizes
            got = named_suffixes(data, starts, sizes, length, gram)
            row = np.searchsorted(starts, got["first"], "right") - 1
            shift = np.array(offsets)[row] - starts[row]
            key = np.array(rows, np.int64).reshape(-1, 2)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0]), pa.array(key[:, 1].astype(np.int32)), pa.array(got["anchor"]), pa.array(got["context"]),
                 pa.array((got["p"] + shift).astype(np.int32)), pa.array((got["p"] - got["first"]).astype(np.int16)),
                 pa.array((got["last"] - got["first"]).astype(np.int16))],
                ["key", "n_bytes", "anchor", "context", "place", "left", "more"])
    return run


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if k not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                new.append(i)
        yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (big-endian uint64 strings): three-way radix quicksort by word."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    width = words.shape[1]
    raw = words.astype(">u8")
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == width:
            continue
        part = order[lo:hi]
        if hi - lo <= 24:
            rest = raw[part, depth:]
            order[lo:hi] = part[sorted(range(hi - lo), key=[r.tobytes() for r in rest].__getitem__)]
            continue
        column = words[part, depth]
        pivot = np.partition(column[:: max(1, len(column) // 9)][:9], 4)[4]
        less, same = column < pivot, column == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~less & ~same]])
        stack += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def _sorted_strings(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the strings and the common prefix of each with the one before it."""
    width = -(-width // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    sizes = np.array([len(s) for s in strings])
    order = multikey_quicksort(table.view(">u8").astype(np.uint64))
    lcp = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 8192):
        a, b = order[at - 1:at + 8191][:len(order) - at], order[at:at + 8192]
        a = a[:len(b)]
        differ = table[a] != table[b]
        same = np.where(differ.any(1), differ.argmax(1), width)
        lcp[at:at + 8192] = np.minimum(same, np.minimum(sizes[a], sizes[b]))
    return order, lcp


def repeated_windows(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """(members, length) booleans: window that starts ``o`` bytes before the suffix is repeated.

    ``left`` ends and ``right`` begins where the suffix starts; a member has the
    windows with ``low <= o <= high``.
    """
    n = len(left)
    by_right, lcp_right = _sorted_strings(right, length)
    by_left, lcp_left = _sorted_strings([x[::-1] for x in left], length)
    out = np.zeros((n, length), bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min(initial=0)), int(high.max(initial=0)) + 1):
        has = np.flatnonzero((low <= o) & (o <= high))
        if len(has) < 2:
            continue
        a[by_right] = np.cumsum(lcp_right < length - o)
        b[by_left] = np.cumsum(lcp_left < o)
        pair = a[has] * (n + 1) + b[has]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out[has[order], o] = twice
    return out


def _contexts(length: int, heavy: bool):
    """Border suffixes with their surroundings, or (heavy) the hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, "text", BUFFER):
                out: list[tuple] = []
                for row in batch.slice(lo, hi - lo).to_pylist():
                    text = row["text"]
                    for m in row["members"]:
                        p, first = m["place"], m["place"] - m["left"]
                        end = first + m["more"] + length
                        if heavy:
                            for s in range(first, first + m["more"] + 1):
                                h = hashlib.blake2b(text[s:s + length], digest_size=16).digest()
                                out.append((row["key"], row["n_bytes"], s, m["done"], h))
                        else:
                            out.append((row["key"], row["n_bytes"], p, m["left"], m["more"], m["done"],
                                        text[first:p], text[p:end], text[p:p + GRAM]))
                        if len(out) >= 20_000:
                            yield _context_batch(out, heavy)
                            out = []
                if out:
                    yield _context_batch(out, heavy)
    return run


def _context_batch(rows: list[tuple], heavy: bool) -> pa.RecordBatch:
    kinds = ([pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()] if heavy else
             [pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()])
    names = (["key", "n_bytes", "start", "done", "window"] if heavy else
             ["key", "n_bytes", "place", "left", "more", "done", "before", "after", "lead"])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _bucket(length: int):
    """Rows come sorted by leading tokens; complete runs of them are handled together."""
    def spans(rows: list[dict]) -> pa.RecordBatch:
        left = [r["before"] for r in rows]
        right = [r["after"] for r in rows]
        high = np.array([r["left"] for r in rows], np.int64)
        low = high - np.array([r["more"] for r in rows], np.int64)
        hit = repeated_windows(left, right, low, high, length)
        out = []
        for i in np.flatnonzero(hit.any(1)):
            r = rows[i]
            if r["done"]:
                continue
            at = np.flatnonzero(hit[i])[::-1]  # ascending window starts
            cut = np.flatnonzero(np.diff(at) < -1) + 1
            for run in np.split(at, cut):
                out.append((r["key"], r["n_bytes"], r["place"] - int(run[0]), r["place"] - int(run[-1]) + length))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          ["key", "n_bytes", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        run_rows: list[dict] = []  # the run of equal leading tokens still open
        for batch in batches:
            for row in batch.to_pylist():
                if run_rows and row["lead"] != run_rows[0]["lead"]:
                    if len(run_rows) > 1:
                        held += run_rows
                    run_rows = []
                    if len(held) >= 20_000:
                        yield spans(held)
                        held = []
                run_rows.append(row)
        if len(run_rows) > 1:
            held += run_rows
        if held:
            yield spans(held)
    return run


def _whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The largest range inside a..b that cuts no UTF-8 character (maybe empty)."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _united(batches: Iterator[pa.RecordBatch], characters: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch, "text"):
            part = batch.slice(lo, hi - lo)
            cuts, kept = [], []
            spans = part.column("spans")
            flat = spans.flatten()
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))
            for text, lo_span, hi_span in zip(part.column("text").to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
                one: list[list[int]] = []
                for a, b in zip(start[lo_span:hi_span].tolist(), stop[lo_span:hi_span].tolist(), strict=True):
                    if one and a <= one[-1][1]:
                        one[-1][1] = max(one[-1][1], b)
                    else:
                        one.append([a, b])
                cuts.append(one)
                rest, at = [], 0
                for a, b in one:
                    if characters:
                        a, b = _whole_characters(text, a, b)
                    rest.append(text[at:a])
                    at = b
                kept.append(b"".join(rest) + text[at:])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("n_bytes"), pa.array(cuts, pa.list_(pa.list_(pa.int32()))),
                 pa.array(kept, pa.binary())], ["key", "n_bytes", "cuts", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` as bytes (null: empty), their hash ``key`` and ``n_bytes``."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumn("text", raw).withColumns({"key": F.xxhash64("text"), "n_bytes": F.length("text")})


def repeats(docs: DataFrame, length: int = LENGTH, characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is repeated in ``docs(text)``, by text.

    Returns ``(key, n_bytes)`` of the texts of at least ``length`` bytes that occur
    more than once (removed from end to end), and ``(key, n_bytes, cuts, kept)`` of
    other texts that lose something: the removed byte ranges, and what is left
    (with ``characters`` a character at the end of a range stays if it is cut).
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM} bytes")
    rows = keyed(docs.select("text"))
    text = rows.select("key", "n_bytes", "text").where(F.col("n_bytes") >= length)
    copied = rows.where(F.col("n_bytes") >= length).groupBy("key", "n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = saved(copied.select("key", "n_bytes"), "suffix-copied")
    found = text.mapInArrow(_occurrences(length, GRAM), "key long, n_bytes int, anchor long, context long, place int, "
                                                        "left short, more short")
    # written first, so that both sides of the joins are plain shuffles, whose hot keys AQE can split
    again = saved(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-again")
    hits = saved(found.join(again, "anchor", "left_semi"), "suffix-hits")
    # of a context found twice only one occurrence stands as a partner of other contexts
    contexts = saved(hits.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "n_bytes", "place")).alias("partner")), "suffix-contexts")
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = saved(several, "suffix-several")
    members = (hits.join(contexts, ["anchor", "context"]).join(several, "anchor", "left")
               .select("key", "n_bytes", F.struct(
                   "place", "left", "more", (F.col("n") > 1).alias("done"),
                   (F.col("kinds").isNotNull() & ((F.col("n") == 1) | (F.col("partner") == F.struct("key", "n_bytes", "place"))))
                   .alias("open"), (F.coalesce("kinds", F.lit(0)) > HEAVY).alias("heavy")).alias("m")))
    members = members.groupBy("key", "n_bytes").agg(F.collect_set("m").alias("members"))
    once = text.mapInArrow(_once_per_task, "key long, n_bytes int, text binary")
    work = saved(once.join(members, ["key", "n_bytes"])
                 .join(copied.withColumn("copied", F.lit(True)), ["key", "n_bytes"], "left"), "suffix-work")
    span = "key long, n_bytes int, start int, stop int"
    part = lambda test: (work.select("key", "n_bytes", "text", F.filter("members", test).alias("members"))
                         .where(F.size("members") > 0))
    light = part(lambda m: m["open"] & ~m["heavy"])
    border = saved(light.mapInArrow(_contexts(length, False), "key long, n_bytes int, place int, left short, more short, done boolean, "
                                                       "before binary, after binary, lead binary"), "suffix-borders")
    spans = (border.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_bucket(length), span))
    if several.where(F.col("kinds") > HEAVY).limit(1).count():
        windows = part(lambda m: m["open"] & m["heavy"]).mapInArrow(_contexts(length, True), "key long, n_bytes int, start int, done boolean, window binary")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        spans = spans.unionByName(windows.where("not done").join(twice, "window", "left_semi")
                                  .select("key", "n_bytes", "start", (F.col("start") + length).alias("stop")))
    spans = spans.groupBy("key", "n_bytes").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    first = lambda m: m["place"].cast("int") - m["left"].cast("int")
    whole = F.transform(F.filter("members", lambda m: m["done"]), lambda m: F.struct(
        first(m).alias("start"), (first(m) + m["more"].cast("int") + F.lit(length)).alias("stop")))
    cut = (work.where("copied is null").select("key", "n_bytes", "text", whole.alias("whole"))
           .join(spans, ["key", "n_bytes"], "left").where("spans is not null or size(whole) > 0")
           .select("key", "n_bytes", "text", F.array_sort(F.concat("whole", F.coalesce("spans", F.array()))).alias("spans"))
           .mapInArrow(lambda b: _united(b, characters), "key long, n_bytes int, cuts array<array<int>>, kept binary"))
    return copied, cut


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs(doc_id, text)``.

    A null text is empty; texts shorter than ``length`` bytes lose nothing; copies of
    a text lose all of it.  Ids are only carried along: repeated or null ones are
    returned as often as they come, other columns are ignored, an empty table gives
    an empty result.
    """
    copied, cut = repeats(docs, length)
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c[1] - c[0])
    cut = cut.select("key", "n_bytes", removed.alias("cut_bytes"), F.size("cuts").cast("long").alias("cut_spans"),
                     F.sha2("kept", 256).alias("cut_sha"))
    whole = copied.select("key", "n_bytes", F.col("n_bytes").cast("long").alias("cut_bytes"), F.lit(1).cast("long").alias("cut_spans"),
                          F.sha2(F.lit(b""), 256).alias("cut_sha"))
    rows = keyed(docs.select("doc_id", "text")).select("doc_id", "key", "n_bytes", F.sha2("text", 256).alias("sha"))
    return rows.join(cut.unionByName(whole), ["key", "n_bytes"], "left").select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.coalesce("cut_bytes", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (all columns, every row) with repeated passages cut out of ``text``.

    Only whole characters are cut.  A null text stays null; a text whose copies are
    in the table too becomes empty; ``n_chars``, where it is a column, is set to
    the new length of changed texts.
    """
    copied, cut = repeats(docs, length, characters=True)
    key, size, kept = (fresh_name(c, docs.columns) for c in ("text_key", "text_size", "kept_text"))
    new = cut.select(F.col("key").alias(key), F.col("n_bytes").alias(size), F.col("kept").cast("string").alias(kept)).unionByName(
        copied.select(F.col("key").alias(key), F.col("n_bytes").alias(size), F.lit("").alias(kept)))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.withColumns({key: F.xxhash64(raw), size: F.length(raw)}).join(new, [key, size], "left")
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
