"""Exact byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece of text exactly one token can come last in its BPE
encoding.  The tokens that end at a prefix are the matches of a suffix-linked
automaton over the vocabulary; the one that stays is the match that is
*compatible* with the last token of the prefix before it.  The stored last
tokens are back-pointers, so the encoding is read off from the end.  The work is
linear in the text, without a merge queue.

Two neighbouring tokens are compatible when BPE on their joined bytes never
merges across the border.  Only the right spine of the left token (the symbols
that touch the border while it is being built) and the left spine of the right
one matter: walk both by merge rank and look for a cross merge that would come
before the next merge inside.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import text_slices

# Fixed value: the piece pattern of byte-level BPE, white space by its Unicode property.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NEVER = 1 << 60
CACHE = 300_000  # pieces remembered per Python worker (a speed-up only)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PrefixBpe:
    """Encoder and decoder over one vocabulary file (public tokenizer JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.chars = {b: c for b, c in enumerate(alphabet)}
        back = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            parts.setdefault(made, (r, *pair))
        # spine: (symbol at the border, rank of the merge that consumes it), outermost last
        self.right = [self._spine(i, parts, 2) for i in range(len(self.token_bytes))]
        self.left = [self._spine(i, parts, 1) for i in range(len(self.token_bytes))]
        self.tested: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    @staticmethod
    def _spine(token: int, parts: dict[int, tuple[int, int, int]], side: int) -> tuple[tuple[int, int], ...]:
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in parts:
                return tuple(reversed(out))
            until, token = parts[token][0], parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.tested.get(key)
        if known is None:
            if len(self.tested) > 4 * CACHE:
                self.tested.clear()
            known = self.tested[key] = self._compatible(self.right[a], self.left[b])
        return known

    def _compatible(self, left: tuple, right: tuple) -> bool:
        i = j = 0
        rank = self.rank.get
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = rank((x, y), NEVER)
            # of equal merges the leftmost comes first: one inside the left token wins, one inside the right loses
            if across < x_until and across <= y_until and across != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> list[int]:
        mapped = piece.encode().decode("latin-1").translate(self.chars)
        n = len(mapped)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(mapped):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - length
            if start == 0 or last[start] >= 0 and compatible(last[start], token):
                last[stop], begin[stop] = token, start
        out = []
        while n > 0:
            out.append(last[n])
            n = begin[n]
        out.reverse()
        return out

    def _plain(self, text: str) -> bytes:
        cache = self.cache
        pieces = self.pieces(text)
        missing = [p for p in set(pieces) if p not in cache]
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = set(pieces)
        for p in missing:
            cache[p] = np.asarray(self.encode_piece(p), np.int32).tobytes()
        return b"".join(map(cache.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        """Token ids; the strings of special tokens in a text are those tokens."""
        if self.split and any(s in text for s in self.special):
            parts = self.split(text)
            raw = b"".join(np.int32(self.special[p]).tobytes() if i % 2 else self._plain(p)
                           for i, p in enumerate(parts))
        else:
            raw = self._plain(text)
        return np.frombuffer(raw, np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> PrefixBpe:
    """One model per Python worker and vocabulary file."""
    return PrefixBpe(path)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                ids = [model.encode(t or "") for t in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array([model.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
    return run


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` per row of ``docs(doc_id, text)``.

    ``ids`` are the exact ids of the byte-level BPE in ``vocab_path``; ``decoded``
    is built from them.  A null or empty text has no ids and decodes to the empty
    string.  Rows are independent: nulls in other columns, repeats, very long
    texts and extra columns change nothing, an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _round_trip(vocab_path), f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: Column) -> DataFrame:
    """Token count and SHA-256 digests of ids and decoded text, and ``more`` columns."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)
