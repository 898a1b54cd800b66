"""Token-id shards as wavelet matrices: one compressed file answers access, count and locate.

Documents are put in ascending doc_id order by range partitioning; every
partition writes its tokens as a run of shards, each one binary value: the number
of zeros of each bit plane, its rank directory (ones before every block), and the
planes from the highest bit down in pieces that are compressed one by one.  A token,
a count or a place is read from the directories and one piece a plane; nothing
else is unpacked.  A value holds at most ``shard_tokens`` tokens plus those of one document.
Shards are rows of a Parquet table in the shared folder, so any file system that
Spark reads will do.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lucerna.llm.common import saved, text_slices

MAGIC = b"LWM2"
UNASSIGNED = 4
BLOCK = 4096  # bits per entry of a rank directory
PIECE = 1 << 17  # bits of a plane that are compressed together
CACHE = 1_500_000  # words remembered per Python worker (a speed-up only)


class _Packed:
    """A bit plane in compressed pieces, unpacked as they are read (the last few are kept)."""

    KEPT = 8

    def __init__(self, raw: memoryview, ends: np.ndarray) -> None:
        self.raw, self.ends, self.open = raw, ends, {}

    def piece(self, i: int) -> np.ndarray:
        if i not in self.open:
            if len(self.open) >= self.KEPT:
                self.open.pop(next(iter(self.open)))
            lo, hi = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
            self.open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[lo:hi]), np.uint8)
        return self.open[i]

    def block(self, b: int) -> np.ndarray:
        """The bytes of one block."""
        at = b * (BLOCK // 8)
        return self.piece(at // (PIECE // 8))[at % (PIECE // 8):][:BLOCK // 8]

    def all(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint8), *(self.piece(i) for i in range(len(self.ends)))])


class _Plain:
    """A bit plane in memory."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def block(self, b: int) -> np.ndarray:
        return self.bits[b * (BLOCK // 8):(b + 1) * (BLOCK // 8)]

    def all(self) -> np.ndarray:
        return self.bits


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes with rank and select."""

    def __init__(self, n: int, planes: list, zeros: list[int], ranks: np.ndarray) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK bits, and in all."""
        per = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if len(plane) else np.empty(0, np.int64)
        return np.concatenate([[0], np.cumsum(per)])

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = values[np.flatnonzero(~one)]  # places, not a mask: masks of random bits are slow
            zeros.append(len(low))
            values = np.concatenate([low, values[np.flatnonzero(one)]])
        return cls(len(values), [_Plain(p) for p in planes], zeros, np.stack([cls._directory(p) for p in planes]))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQB", MAGIC, self.n, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        packer = zstandard.ZstdCompressor(level=1)
        step = PIECE // 8
        pieces = [[packer.compress(bits[at:at + step].tobytes()) for at in range(0, len(bits), step)]
                  for bits in (p.all() for p in self.planes)]
        sizes = np.array([[len(x) for x in p] for p in pieces], "<u8")
        return b"".join([head, self.ranks.astype("<u8").tobytes(), sizes.tobytes(), *(x for p in pieces for x in p)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """Reads the directories; the planes stay compressed until they are asked for."""
        magic, n, bits = struct.unpack_from("<4sQB", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        at = struct.calcsize("<4sQB")

        def numbers(rows: int, columns: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, "<u8", rows * columns, at).astype(np.int64).reshape(rows, columns)
            at += 8 * rows * columns
            return out
        zeros = numbers(1, bits)[0].tolist()
        ranks = numbers(bits, -(-n // BLOCK) + 1)
        ends = np.cumsum(numbers(bits, -(-n // PIECE)).ravel()).reshape(bits, -1)
        data = memoryview(raw)[at:]
        planes, begin = [], 0
        for row in ends:
            planes.append(_Packed(data[begin:int(row[-1])] if len(row) else data[:0], row - begin))
            begin = int(row[-1]) if len(row) else 0
        return cls(n, planes, zeros, ranks)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        ones = int(self.ranks[level][block])
        if not rest:
            return ones
        part = self.planes[level].block(block)[:(rest + 7) // 8]
        ones += int(np.bitwise_count(part).sum())
        return ones - (int(part[-1]) >> (rest % 8)).bit_count() if rest % 8 else ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane: the block by the directory, the place within the block."""
        before = self.ranks[level] if bit else np.minimum(np.arange(len(self.ranks[level])) * BLOCK, self.n) - self.ranks[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level].block(block), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level].block(i // BLOCK)[i % BLOCK // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The value at position ``i``."""
        value = 0
        for level in range(len(self.planes)):
            ones = self.rank1(level, i)
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _interval(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(len(self.planes)):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, i: int | None = None) -> int:
        """Occurrences among the first ``i`` values (all by default)."""
        if value >> len(self.planes):
            return 0
        lo, hi = self._interval(value, self.n if i is None else i)
        return hi - lo

    def locate(self, value: int) -> list[int]:
        """Positions of all occurrences, ascending."""
        if value >> len(self.planes):
            return []
        lo, hi = self._interval(value, self.n)
        out = []
        for at in range(lo, hi):
            for level in range(len(self.planes) - 1, -1, -1):
                bit = at >= self.zeros[level]
                at = self.select(level, int(bit), at - self.zeros[level] if bit else at)
            out.append(at)
        return out

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the lowest up."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].all(), count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(values)
            before[np.flatnonzero(~one)] = values[:self.zeros[level]]
            before[np.flatnonzero(one)] = values[self.zeros[level]:] | values.dtype.type(1 << len(self.planes) - 1 - level)
            values = before
        return values


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """Kind of each code point: 0 white space, 1 letter, 2 number, 3 anything else, 4 unassigned in Python's tables."""
    out = np.full(0x110000, 3, np.uint8)
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, place = "".join(map(chr, cps)), np.array(cps)
    for pattern, kind in ((r"\p{White_Space}+", 0), (r"\p{L}+", 1), (r"\p{N}+", 2)):
        for m in regex.finditer(pattern, every):
            out[place[m.start():m.end()]] = kind
    out[[c for c in cps if unicodedata.category(chr(c)) == "Cn"]] = UNASSIGNED
    return out


class WordEncoder:
    """The tokenizers library, asked once per distinct word instead of once per occurrence.

    Its normaliser (NFC, lower case) and word pattern (letters, single numbers, other
    characters) are applied to many texts at
    a time: runs of one kind of character are the words, found and hashed as
    arrays.  Words not seen yet are encoded by the library in batches.  This equals
    encoding whole texts, since its BPE never looks across words.  Words are kept
    beside their hashes, and every word is compared with the one its hash stands for.
    Texts with a word whose hash is another word's, a contraction, the string of a
    special token or a character newer than Python's tables go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.contraction = regex.compile("'(?:s|t|re|ve|m|ll|d)").search
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.size = self.tokenizer.get_vocab_size()
        self.border = self._ids(["0"])[0]
        odd = 0x9E3779B97F4A7C15
        self.power, self.inverse = (self._powers(x, 1 << 16) for x in (odd, pow(odd, -1, 1 << 64)))
        self._forget()

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}  # word hash to its place in at and size
        self.flat, self.at, self.sizes = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)
        self.used = 0
        self.letters, self.letter_at = np.empty(1 << 21, np.uint32), np.zeros((1 << 18) + 1, np.int64)  # the words themselves

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Encode new words, sixty to a text with a digit between them; the digit's id is in no other word."""
        found: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for at in range(0, len(words), 60 * 64):
            groups = [words[i:i + 60] for i in range(at, min(at + 60 * 64, len(words)), 60)]
            for group, ids in zip(groups, self._ids([" 0 ".join(g) + " 0" for g in groups]), strict=True):
                border = ids == self.border[-1]
                cuts = np.flatnonzero(border)
                if len(self.border) == 1 and len(cuts) == len(group):
                    found.append(ids[~border])
                    lengths.append(np.diff(cuts, prepend=-1) - 1)
                else:  # the group has numbers
                    own = self._ids(group)
                    found += own
                    lengths.append(np.array([len(x) for x in own]))
        n, sizes, many = len(self.slot), np.concatenate(lengths), len(words)
        while n + many > len(self.at):
            self.at, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.sizes))
        while self.used + sizes.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.at[n:n + many] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:n + many] = sizes
        self.flat[self.used:self.used + sizes.sum()] = np.concatenate(found)
        self.used += int(sizes.sum())
        if len(self.at) >= len(self.letter_at):
            self.letter_at = np.concatenate([self.letter_at, np.zeros(len(self.at) + 1 - len(self.letter_at), np.int64)])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letter_at[n + 1:n + 1 + len(words)] = self.letter_at[n] + np.cumsum([len(w) for w in words])
        while self.letter_at[n] + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.empty_like(self.letters)])
        self.letters[self.letter_at[n]:self.letter_at[n] + len(letters)] = letters
        self.slot.update(zip(hashes, range(n, n + many), strict=True))

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # no final sigma: characters are lowered one by one
        return text.lower()

    def _whole(self, text: str) -> np.ndarray:
        """One text by the library itself, for what runs of characters do not cover."""
        return self._ids([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        parts: list[str] = []
        for i, t in enumerate(texts):
            low = self._normal(t)
            if "'" in low and self.contraction(low) or any(s in t for s in self.special):
                out[i] = self._whole(t)
            else:
                plain.append(i)
                parts.append(low)
        if plain:
            for i, ids in zip(plain, self._runs(parts), strict=True):
                out[i] = self._whole(texts[i]) if ids is None else ids
        return out

    def _runs(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of normalised texts; None where a character is unassigned."""
        joined = "\n".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cps):
            return [np.empty(0, np.uint32)] * len(texts)
        kind = character_kinds()[cps]
        ends = np.cumsum([len(t) + 1 for t in texts])
        odd = np.searchsorted(ends, np.flatnonzero(kind == UNASSIGNED), "right")
        begin = np.concatenate([[0], np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1])
        end = np.append(begin[1:], len(cps))
        word = kind[begin] > 0
        begin, end = begin[word], end[word]
        while len(self.power) < len(cps):
            self.power, self.inverse = (np.append(x, x * (x[-1:] * x[1:2])) for x in (self.power, self.inverse))
        x = (cps.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD1342543DE82EF95)
        x ^= x >> np.uint64(29)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.power[:len(cps)])])
        hashes = ((prefix[end] - prefix[begin]) * self.inverse[begin]) ^ (end - begin).astype(np.uint64)
        distinct, which = np.unique(hashes, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slot) + len(keys) > CACHE:
            self._forget()
        slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.empty(len(keys), np.int64)
            where[which] = np.arange(len(which))
            spots = where[new]
            self._learn([keys[i] for i in new], [joined[a:b] for a, b in zip(begin[spots].tolist(), end[spots].tolist(), strict=True)])
            slots[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        slot = slots[which]
        # the letters of every word against those its hash stands for
        length, kept = end - begin, self.letter_at[slot + 1] - self.letter_at[slot]
        wrong = length != kept
        same = np.flatnonzero(~wrong)
        stop = np.cumsum(length[same])
        spot = np.arange(stop[-1] if len(stop) else 0)
        theirs = self.letters[np.repeat(self.letter_at[slot[same]] - (stop - length[same]), length[same]) + spot]
        # the letters of all words in a row are all characters but white space
        own = cps[np.repeat(begin[same] - (stop - length[same]), length[same]) + spot] if wrong.any() else cps[kind > 0]
        wrong[same[np.searchsorted(stop, np.flatnonzero(own != theirs), "right")]] = True
        odd = np.append(odd, np.searchsorted(ends, begin[wrong], "right"))
        sizes = self.sizes[slot]
        stop = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[slot] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)]
        upto = np.concatenate([[0], stop])[np.searchsorted(begin, ends)]
        out: list[np.ndarray | None] = np.split(ids, upto[:-1])
        for i in odd:
            out[i] = None
        return out


@lru_cache(1)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        narrow = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
        end = narrow(end_id).tobytes()
        for batch in batches:
            for lo, hi in text_slices(batch, "text", 1 << 20):
                part = batch.slice(lo, hi - lo)
                ids = [x.astype(narrow).tobytes() + end
                       for x in encoder.encode_many([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return run


def _pack(width: int, bits: int, shard_tokens: int):
    """Shards of one partition; ``first`` is the position of a shard in its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, first = 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), f"<u{width}")
            lengths = [len(x) // width for x in ids]
            row = [part, seq, first, len(values), docs, lengths, WaveletMatrix.build(values, bits).to_bytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                              ["part", "seq", "first", "n", "doc_ids", "lengths", "data"])

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(x)
                docs.append(d)
                held += len(x) // width
                if held >= shard_tokens:
                    yield shard()
                    seq, first = seq + 1, first + held
                    ids, docs, held = [], [], 0
        if ids:
            yield shard()
    return run


def write_shards(docs: DataFrame, vocab_path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode, order by doc_id (nulls first) and write; returns the shard table read back.

    Rows of one doc_id follow by a hash of their ids, equal rows as they were
    read; the ranges are cut in that order too, so rows of one id are spread.

    Rows: ``part, seq`` (their order is the token order), ``first`` (position in the
    part), ``n``, ``doc_ids``, ``lengths`` and the compressed ``data``.
    """
    size = max(load(vocab_path).size, end_id + 1)
    bits = max(1, (size - 1).bit_length())
    width = 2 if size <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(vocab_path, end_id), "doc_id long, ids binary")
    # the range splitters are sampled from the rows: encode once
    rows = saved(rows.select("doc_id", "ids", F.xxhash64("ids").alias("mark"), F.monotonically_increasing_id().alias("turn")),
                 "wavelet-ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("turn")]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
                 .mapInArrow(_pack(width, bits, shard_tokens),
                             "part int, seq int, first long, n long, doc_ids array<long>, lengths array<int>, data binary"),
                 "wavelet-shards")


def _read(starts) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["data"]).all().astype("<u4")
                ends = np.cumsum(row["lengths"])
                begin = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begin + starts.value[row["part"]] + row["first"]),
                     pa.array(np.asarray(row["lengths"], np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the shards.

    Only one total per part reaches the driver, which turns them into offsets.
    """
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n")).collect())
    starts, at = {}, 0
    for part, n in totals:
        starts[part], at = at, at + n
    shared = shards.sparkSession.sparkContext.broadcast(starts)
    return shards.select("part", "first", "doc_ids", "lengths", "data").mapInArrow(
        _read(shared), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, vocab_path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Write the shards of ``docs(doc_id, text)`` and describe each document as read back.

    A null or empty text holds the end id alone; a null doc_id sorts first; rows of
    one id follow by a hash of their token ids; repeated rows stay; other columns
    are ignored; an empty table gives an empty result.  Texts of any length are
    encoded whole, and a shard holds a document whole.
    """
    return read_documents(write_shards(docs, vocab_path, end_id, shard_tokens))
