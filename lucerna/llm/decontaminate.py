"""Benchmark decontamination by latent semantic retrieval.

1. Every whole text is read once as a sequence of benchmark-word numbers (other
   words are -1; they can neither add to a cosine numerator nor to a common
   subsequence with an item) and saved.
2. Document frequencies over the distinct texts give the IDF weights; no word is
   cut, however common: an item of everyday words, or of a passage that stands in
   a third of the rows, keeps its weight.
3. Items are grouped by length, so that an item fits in its group's window (64
   words, 128, 256 ...).  Texts are cut into blocks of half a window.  The blocks'
   normalised TF-IDF rows (a word counts once a block), with the group's items
   stacked at a multiple of their total weight, form a matrix A whose right singular
   vectors come from a distributed randomised decomposition: tasks add up A'(A G)
   for a random G, and the small result (words x rank) is solved by the Nystroem
   formula.  The rank grows with the items, and the items' weight bends the space
   towards them.
4. A passage is two neighbouring blocks.  A passage and an item are a candidate if
   their cosine in the latent space reaches the floor at which the passage holds
   ``share`` of the item's squared length, ``share |item| / |passage|``, lengths in
   that space.  The space alone decides: no product of the original rows is formed.
   A verbatim item lies within one passage or half of it at least in one of two.
5. Candidates go on to the word checks.  An item's sentences are matched one by one
   (a paraphrase may change their order): the longest common subsequences of its
   sentences and the surrounding words must hold most of the item, by words and by
   weight, and part of its answer (its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import fresh_name, saved, text_slices

WORD = re.compile(r"\w+")
OFTEN = 512  # commonest words of a group, multiplied as a dense block
TOGETHER = 128 << 20  # bytes of latent spaces that are searched in one pass
BLOCK_ITEMS = 5_000  # items handled per pass (bounds what is broadcast); a larger benchmark is handled in blocks


@dataclass(frozen=True)
class Settings:
    window: int = 64  # words of the shortest passages (doubled until an item fits); passages overlap by half
    group: int = 512  # most items that share a latent space
    rank: int = 96  # least latent dimensions; one for two items if those are more
    oversample: int = 16  # further dimensions
    pull: float = 64.0  # total weight of the items in the decomposition, that of all blocks being 1
    share: float = 0.4  # of an item's squared latent length in a candidate passage
    overlap: float = 0.6  # share of an item's words, and of their weight, in the common subsequence
    answer: float = 0.5  # share of its last sentence's words among them
    seed: int = 7


@dataclass
class Items:
    """The benchmark's items as word numbers, with their answers' places."""

    ids: list[int]
    words: list[np.ndarray]
    borders: list[list[int]]  # where the sentences begin, and the end
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words, borders = [], [], []
        for item, text in rows:
            found = [WORD.findall(x) for x in re.split(r"(?<=[.!?:])\s+|\n", text.lower())]
            found = [x for x in found if x]
            if not found:
                continue
            ids.append(item)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for x in found for w in x], np.int32))
            borders.append(np.cumsum([0, *map(len, found)]).tolist())
        return cls(ids, words, borders, vocabulary)


@dataclass
class Group:
    """Items of one window size with words numbered among themselves."""

    window: int
    ids: list[int]
    words: list[np.ndarray]
    borders: list[list[int]]
    own: np.ndarray  # a word's number in the group by its number in the block; -1: none, also in the last place
    weight: np.ndarray
    often: np.ndarray  # the commonest words
    place: np.ndarray  # a word's place among those, or -1


def groups_of(items: Items, weight: np.ndarray, s: Settings) -> list[Group]:
    """The items by window size, in groups of at most ``s.group``."""
    sizes: dict[int, list[int]] = {}
    for k, w in enumerate(items.words):
        window = s.window
        while window < len(w):
            window *= 2
        sizes.setdefault(window, []).append(k)
    out = []
    for window, members in sorted(sizes.items()):
        for at in range(0, len(members), s.group):
            chosen = members[at:at + s.group]
            used = np.unique(np.concatenate([items.words[k] for k in chosen]))
            own = np.full(len(weight) + 1, -1, np.int32)
            own[used] = np.arange(len(used))
            often = np.argsort(weight[used], kind="stable")[:OFTEN]
            place = np.full(len(used), -1)
            place[often] = np.arange(len(often))
            out.append(Group(window, [items.ids[k] for k in chosen], [own[items.words[k]] for k in chosen],
                             [items.borders[k] for k in chosen], own, weight[used], often, place))
    return out


def _numbers(vocabulary) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, find = vocabulary.value.get, WORD.findall
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                raw = [np.array([get(w, -1) for w in find((t or "").lower())], np.int32).tobytes()
                       for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(raw, pa.binary())],
                                                 ["doc_id", "key", "words"])
    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = (np.unique(np.frombuffer(raw.as_buffer(), np.int32)) for raw in batch.column("words"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([w[w >= 0].tobytes() for w in found], pa.binary())],
                                         ["key", "words"])


def _document_frequency(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(size, np.int64), 0
        for batch in batches:
            for raw in batch.column("words"):
                df[np.frombuffer(raw.as_buffer(), np.int32)] += 1
            docs += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["word", "n"])
    return run


def block_rows(texts: list[np.ndarray], weight: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF entries of all blocks of ``half`` words: (block, word), sorted, and each text's first block (and the end).

    Blocks are numbered through all texts; a word counts once a block.
    """
    counts = np.array([-(-len(w) // half) for w in texts])
    starts = np.concatenate([[0], np.cumsum(counts)])
    keys = []
    for first, w in zip(starts[:-1].tolist(), texts, strict=True):
        at = np.flatnonzero(w >= 0)
        keys.append((first + at // half) * len(weight) + w[at])
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // len(weight), key % len(weight), starts


def _times(passage: np.ndarray, word: np.ndarray, value: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix; entries are sorted by passage."""
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    out = np.empty((len(starts), right.shape[1]), np.float32)
    for at in range(0, len(starts), 256):  # pieces that stay in the processor's cache
        lo = starts[at]
        hi = starts[at + 256] if at + 256 < len(starts) else len(passage)
        out[at:at + 256] = np.add.reduceat(right[word[lo:hi]] * value[lo:hi, None], starts[at:at + 256] - lo, axis=0)
    return out


def _blocks(passage: np.ndarray, word: np.ndarray, value: np.ndarray, rows: int, g: Group, size: int = 2048) -> Iterator[tuple]:
    """Sparse rows in pieces: (first row, dense block of the commonest words)."""
    at = g.place[word]
    dense = np.flatnonzero(at >= 0)
    p, a, v = passage[dense], at[dense], value[dense]
    for first in range(0, rows, size):
        lo, hi = np.searchsorted(p, (first, first + size))
        block = np.zeros((min(size, rows - first), len(g.often)), np.float32)
        block[p[lo:hi] - first, a[lo:hi]] = v[lo:hi]
        yield first, block


def _project(passage: np.ndarray, word: np.ndarray, value: np.ndarray, rows: int, right: np.ndarray, g: Group) -> np.ndarray:
    """All rows times a dense matrix: the commonest words as dense pieces, the others one by one."""
    out = np.empty((rows, right.shape[1]), np.float32)
    often = right[g.often]
    for first, block in _blocks(passage, word, value, rows, g):
        out[first:first + len(block)] = block @ often
    rest = g.place[word] < 0
    if rest.any():
        p = passage[rest]
        out[np.unique(p)] += _times(p, word[rest], value[rest], right)
    return out


def _slices(batches: Iterator[pa.RecordBatch], words: int = 400_000) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Documents of about ``words`` words at a time: ids, text keys and word numbers."""
    ids, keys, texts, held = [], [], [], 0
    for batch in batches:
        for d, key, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key")), batch.column("words"), strict=True):
            ids.append(d)
            keys.append(key)
            texts.append(np.frombuffer(raw.as_buffer(), np.int32))
            held += len(texts[-1])
            if held >= words:
                yield ids, keys, texts
                ids, keys, texts, held = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _sketch(shared):
    """A'(A G) over a task's blocks, for every group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, seed = shared.value
        gauss = [random_directions(g, rank, seed) for g, rank in groups]
        totals, rows = [np.zeros(x.shape) for x in gauss], [0] * len(groups)
        for _, _, texts in _slices(batches):
            for i, (g, _) in enumerate(groups):
                p, w, starts = block_rows([g.own[t] for t in texts], g.weight, g.window // 2)
                if not len(p):
                    continue
                v = g.weight[w]
                v = (v / np.sqrt(np.bincount(p, v * v.astype(np.float64)))[p]).astype(np.float32)
                y = _project(p, w, v, int(starts[-1]), gauss[i], g)
                for first, block in _blocks(p, w, v, int(starts[-1]), g):
                    totals[i][g.often] += block.T @ y[first:first + len(block)]
                rest = np.flatnonzero(g.place[w] < 0)
                rest = rest[np.argsort(w[rest], kind="stable")]
                if len(rest):
                    ws = w[rest]
                    begin = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
                    totals[i][ws[begin]] += np.add.reduceat(y[p[rest]] * v[rest][:, None], begin, axis=0)
                rows[i] += int((np.diff(p, prepend=-1) > 0).sum())
        for i, total in enumerate(totals):
            if rows[i]:
                used = np.flatnonzero(total.any(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used) + 1, i)), pa.array(np.append(used, -1)),
                     pa.array([*(r.tobytes() for r in total[used]), np.float64([rows[i]]).tobytes()], pa.binary())], ["grp", "word", "row"])
    return run


def random_directions(g: Group, rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((len(g.weight), rank)).astype(np.float32)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and word: adds the vectors of each word."""
    def out(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([total.tobytes()])],
                                          ["grp", "word", "row"])
    now, total = None, None
    for batch in batches:
        for key, raw in zip(zip(*(batch.column(c).to_pylist() for c in ("grp", "word")), strict=True), batch.column("row").to_pylist(),
                            strict=True):
            x = np.frombuffer(raw)
            if key == now:
                total = total + x
            else:
                if now is not None:
                    yield out(now, total)
                now, total = key, x
    if now is not None:
        yield out(now, total)


def item_rows(g: Group) -> np.ndarray:
    """TF-IDF rows of a group's items (items x words); a word counts once."""
    rows = np.zeros((len(g.words), len(g.weight)), np.float32)
    for row, w in zip(rows, g.words, strict=True):
        row[w] = g.weight[w]
    return rows


def rank_of(g: Group, s: Settings) -> int:
    return min(len(g.weight), max(s.rank, len(g.ids) // 2) + s.oversample)


def latent_spaces(numbers: DataFrame, groups: list[Group], s: Settings) -> list[np.ndarray]:
    """Right singular vectors (words x rank) of blocks and items of every group by a randomised decomposition.

    One pass for all groups.  What reaches the driver is words x rank numbers a
    group, bounded by the benchmark and not by the documents.
    """
    shared = numbers.sparkSession.sparkContext.broadcast(([(g, rank_of(g, s)) for g in groups], s.seed))
    rows = (numbers.mapInArrow(_sketch(shared), "grp long, word long, row binary")
            .repartition("grp", "word").sortWithinPartitions("grp", "word").mapInArrow(_sum_rows, "grp long, word long, row binary").toArrow())
    totals, n = [np.zeros((len(g.weight), rank_of(g, s))) for g in groups], [1.0] * len(groups)
    for i, w, raw in zip(rows.column("grp").to_pylist(), rows.column("word").to_pylist(), rows.column("row").to_pylist(), strict=True):
        if w < 0:
            n[i] = float(np.frombuffer(raw)[0])
        else:
            totals[i][w] = np.frombuffer(raw)
    out = []
    for g, total, blocks in zip(groups, totals, n, strict=True):
        gauss = random_directions(g, rank_of(g, s), s.seed)
        own = item_rows(g)
        own /= np.linalg.norm(own, axis=1)[:, None]
        total = total / blocks + s.pull / len(own) * (own.T @ (own @ gauss)).astype(np.float64)
        core = gauss.T.astype(np.float64) @ total  # G' A'A G
        value, vector = np.linalg.eigh((core + core.T) / 2)
        good = value > max(value.max(initial=0), 1e-30) * 1e-9
        basis, _ = np.linalg.qr(total @ (vector[:, good] / np.sqrt(value[good])))
        out.append(basis.astype(np.float32))
    return out


def common_words(item: dict[int, int], n: int, text: list[int]) -> int:
    """Mask of the item's places in one longest common subsequence with ``text`` (bit-parallel)."""
    full = (1 << n) - 1
    row, rows = full, [full]
    for w in text:
        u = row & item.get(w, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    mask, i, j = 0, n, len(text)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            mask |= 1 << i
    return mask


def candidates(texts: list[np.ndarray], latent: np.ndarray, basis: np.ndarray, g: Group, s: Settings) -> Iterator[tuple[int, int, int]]:
    """(text, first word of the passage, item) wherever the latent cosine reaches the floor.

    ``cosine >= share |item| / |passage|`` is the same as ``passage . item >= share |item|^2``.
    """
    half = g.window // 2
    p, w, starts = block_rows(texts, g.weight, half)
    if not len(p):
        return
    blocks = _project(p, w, g.weight[w], int(starts[-1]), basis, g)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    inner = np.append(text[1:] == text[:-1], False)  # the next block is of the same text
    alone = np.diff(starts)[text] == 1
    floor = s.share * np.einsum("ij,ij->i", latent, latent)
    for at in range(0, len(blocks), 4096):
        i = np.flatnonzero(inner[at:at + 4096] | alone[at:at + 4096]) + at
        rows = blocks[i]
        two = inner[i]
        rows[two] += blocks[i[two] + 1]
        a, k = np.nonzero(rows @ latent.T >= floor)
        i = i[a]
        yield from zip(text[i].tolist(), ((i - starts[text[i]]) * half).tolist(), k.tolist(), strict=True)


class Checker:
    """The word checks of a group's items."""

    def __init__(self, g: Group, s: Settings) -> None:
        self.g, self.s = g, s
        self.mass = [g.weight[w] for w in g.words]
        self.least = [s.overlap * float(m.sum()) for m in self.mass]
        self.present = np.zeros(len(g.weight) + 1, bool)  # the last place stands for -1
        self.places: list[list[dict[int, int]]] = []
        for w, b in zip(g.words, g.borders, strict=True):
            sentences = []
            for lo, hi in zip(b[:-1], b[1:], strict=True):
                at: dict[int, int] = {}
                for i, x in enumerate(w[lo:hi].tolist()):
                    at[x] = at.get(x, 0) | 1 << i
                sentences.append(at)
            self.places.append(sentences)

    def overlap(self, text: np.ndarray, first: int, k: int) -> float:
        """Share of item ``k``'s words in common subsequences with the passage and its surroundings; 0 if a check fails."""
        g, s, n, borders = self.g, self.s, len(self.g.words[k]), self.g.borders[k]
        near = text[max(0, first - n):first + g.window + n]
        # no common subsequence holds more than the item's words that occur here at all
        self.present[near] = True
        self.present[-1] = False
        bound = self.mass[k][self.present[g.words[k]]].sum()
        self.present[near] = False
        if bound < self.least[k]:
            return 0.0
        near = near[near >= 0].tolist()
        taken = np.zeros(n, bool)
        for at, lo, hi in zip(self.places[k], borders[:-1], borders[1:], strict=True):
            mask = common_words(at, hi - lo, near)
            taken[lo:hi] = [mask >> x & 1 for x in range(hi - lo)]
        held = int(taken.sum())
        last = taken[borders[-2]:]
        if held < s.overlap * n or self.mass[k][taken].sum() < self.least[k] or last.sum() < s.answer * len(last):
            return 0.0
        return held / n


def _search(shared, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(g, basis, item_rows(g) @ basis, Checker(g, s)) for g, basis in shared.value]
        for ids, keys, texts in _slices(batches):
            hits: list[dict] = [{} for _ in ids]
            for g, basis, latent, checker in groups:
                own = [g.own[t] for t in texts]
                for d, first, k in candidates(own, latent, basis, g, s):
                    if hits[d].get(g.ids[k], 0.0) < 1.0 and (held := checker.overlap(own[d], first, k)):
                        hits[d][g.ids[k]] = max(hits[d].get(g.ids[k], 0.0), held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(keys), pa.array([bool(h) for h in hits]),
                 pa.array([sorted(h) for h in hits], pa.list_(pa.int64())),
                 pa.array([max(h.values(), default=0.0) for h in hits], pa.float64())],
                ["doc_id", "key", "contaminated", "item_ids", "overlap"])
    return run


def passes(groups: list[Group], s: Settings) -> list[list[Group]]:
    """The groups by pass: together, their latent spaces stay within TOGETHER bytes (one group at least)."""
    out: list[list[Group]] = []
    held = 0
    for g in groups:
        size = 4 * len(g.weight) * rank_of(g, s)
        if not out or held + size > TOGETHER:
            out.append([])
            held = 0
        out[-1].append(g)
        held += size
    return out


def _block(docs: DataFrame, items: Items, s: Settings) -> list[DataFrame]:
    """The rows with their text keys and the items found, once for every pass."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    numbers = saved(keyed.mapInArrow(_numbers(sc.broadcast(items.vocabulary)), f"doc_id {kind}, key long, words binary"),
                    "lsa-words")
    # copies of a text count once; each task keeps one of them before the shuffle
    texts = numbers.select("key", "words").mapInArrow(_distinct_words, "key long, words binary").dropDuplicates(["key"])
    counts = {r[0]: r[1] for r in texts.mapInArrow(_document_frequency(len(items.vocabulary)), "word long, n long")
              .groupBy("word").agg(F.sum("n")).collect()}
    total = counts.get(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(len(items.vocabulary))], np.float64)
    weight = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    parts = []
    for groups in passes(groups_of(items, weight, s), s):
        found = _search(sc.broadcast(list(zip(groups, latent_spaces(numbers, groups, s), strict=True))), s)
        parts.append(numbers.mapInArrow(found, f"doc_id {kind}, key long, contaminated boolean, item_ids array<long>, overlap double"))
    return parts


def find_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """``(doc_id, contaminated, item_ids, overlap)`` per row of ``docs(doc_id, text)``.

    ``item_ids`` are the benchmark items found, ascending, ``overlap`` the largest
    share of an item's words found.  A null or empty text, and every text if the
    benchmark is empty, is not contaminated; items that are null, empty or without
    words are no queries; repeated items count once.  Repeated rows are returned
    as often as they come and other columns are ignored.  Texts of any length are
    searched whole, some 400,000 words at a time or one text.  The benchmark is the
    stated query set: one of more than 5,000 items is searched block by block.
    """
    s = s or Settings()
    docs = docs.select("doc_id", "text")
    queries = (benchmark.where("text is not null and item_id is not null")
               .select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    blocks = max(1, -(-queries.count() // BLOCK_ITEMS))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items.of(sorted((r[0], r[1]) for r in rows))
        if items.ids:
            parts += _block(docs, items, s)
    if not parts:
        return docs.select("doc_id", F.lit(False).alias("contaminated"),
                           F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("overlap"))
    if len(parts) == 1:
        return parts[0].drop("key")
    # a row's copies (same id and text) have one verdict and keep their number: each part returns every row once
    once = [p.groupBy("doc_id", "key").agg(F.first("item_ids").alias("item_ids"), F.max("overlap").alias("overlap"),
                                           F.count(F.lit(1)).cast("int").alias("copies")) for p in parts]
    out = once[0]
    for p in once[1:]:
        out = out.unionByName(p)
    joined = out.groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.max("overlap").alias("overlap"), F.max("copies").alias("copies"))
    return joined.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap",
                         F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("c")).drop("c")


def keep_clean(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is not contaminated.

    The verdict depends on the text alone, so rows are matched by text hash and
    length; rows with a null text stay.
    """
    key = fresh_name("text_key", docs.columns)
    name = F.concat_ws("-", F.hex(F.xxhash64("text")), F.octet_length("text"))
    found = find_contaminated(docs.select(name.alias("doc_id"), "text"), benchmark, s)
    bad = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, name).join(bad, key, "left_anti").select(*docs.columns)
