"""H1 for whole columns: the first 32 bits of md5(key || suffix), worked out in numpy.

``md5`` of the engine hashes one text at a time.  Where one key meets hundreds of
suffixes, the rounds of md5 are run here on all of them together: only the words
of a block that hold the key's bytes differ from row to row, the others are constants.
The numbers are those of :func:`lucerna.functions.hashing.hash_uniform`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

CELLS = 1 << 14  # hashes worked out together: their arrays fit a core's cache
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINE = [int(abs(np.sin(np.float64(i + 1))) * 2 ** 32) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _block(state: list[np.ndarray], words: list, last: bool) -> list[np.ndarray]:
    """``state`` after one block of sixteen words (numbers, or arrays that broadcast); of the ``last`` one only the first word."""
    a, b, c, d = (s.copy() for s in state)
    t, r = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(t, np.uint32(_SINE[i] + word & 0xFFFFFFFF), out=t)
        else:
            np.add(t, np.uint32(_SINE[i]), out=t)
            np.add(t, word, out=t)
        np.right_shift(t, np.uint32(32 - _TURN[i]), out=r)
        np.left_shift(t, np.uint32(_TURN[i]), out=t)
        np.bitwise_or(t, r, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    if last:
        return [state[0] + b]
    return [s + x for s, x in zip(state, (a, b, c, d), strict=True)]


class Keys:
    """The texts of one column without nulls, ready to be hashed with suffixes."""

    def __init__(self, texts: pa.Array):
        data = texts.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        self.n = len(data)
        self.group = np.zeros(self.n, np.int64)
        self.place = np.zeros(self.n, np.int64)
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []  # length in bytes, rows, words of the key's bytes
        for g, size in enumerate(np.unique(lengths)):
            rows = np.flatnonzero(lengths == size)
            padded = np.zeros((len(rows), -(-int(size) // 4) * 4), np.uint8)
            padded[:, :size] = raw[offsets[rows][:, None] + np.arange(size)]
            self.group[rows], self.place[rows] = g, np.arange(len(rows))
            self.groups.append((int(size), rows, np.ascontiguousarray(padded.view("<u4").T)))

    @staticmethod
    def _ends(size: int, suffixes: Sequence[bytes]) -> np.ndarray:
        """Per suffix the words of a message whose first ``size`` bytes are still zero."""
        whole = size + len(suffixes[0])
        out = np.zeros((len(suffixes), ((whole + 8) // 64 + 1) * 64), np.uint8)
        out[:, size:whole] = np.array([np.frombuffer(s, np.uint8) for s in suffixes]).reshape(len(suffixes), -1)
        out[:, whole] = 0x80
        out[:, -8:] = np.frombuffer((whole * 8).to_bytes(8, "little"), np.uint8)
        return out.view("<u4")

    @staticmethod
    def _run(shape: tuple[int, ...], ends: np.ndarray, words: np.ndarray, at_end, at_key) -> np.ndarray:
        state = [np.full(shape, s, np.uint32) for s in _START]
        blocks = ends.shape[1] // 16
        for k in range(blocks):
            block: list = []
            for w in range(16 * k, 16 * k + 16):
                end = ends[:, w]
                end = int(end[0]) if (end == end[0]).all() else at_end(end)
                if w < len(words):
                    key = at_key(words[w])
                    end = key | (np.uint32(end) if isinstance(end, int) else end)
                block.append(end)
            state = _block(state, block, k == blocks - 1)
        return state[0].byteswap()

    def first32(self, suffixes: Sequence[bytes]) -> np.ndarray:
        """``(suffixes, keys)``: the first 32 bits of every key with every suffix."""
        out = np.empty((len(suffixes), self.n), np.uint32)
        sizes = np.array([len(s) for s in suffixes])
        for of in np.unique(sizes):
            which = np.flatnonzero(sizes == of)
            for size, rows, words in self.groups:
                ends = self._ends(size, [suffixes[i] for i in which])
                wide = min(len(rows), CELLS)
                step = max(1, CELLS // wide)
                for lo in range(0, len(rows), wide):
                    some = words[:, lo:lo + wide]
                    for k in range(0, len(which), step):
                        e = ends[k:k + step]
                        got = self._run((len(e), some.shape[1] if len(some) else len(rows[lo:lo + wide])), e, some,
                                        lambda x: x[:, None], lambda x: x[None, :])
                        out[which[k:k + step, None], rows[lo:lo + wide]] = got
        return out

    def first32_at(self, suffixes: Sequence[bytes], which: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The first 32 bits of ``key[i]`` with suffix ``which[i]``, for pairs of numbers of both."""
        out = np.empty(len(key), np.uint32)
        sizes = np.array([len(s) for s in suffixes])
        kinds = np.unique(sizes)
        for of in kinds:
            mine = np.flatnonzero(sizes == of)
            rank = np.zeros(len(suffixes), np.int64)
            rank[mine] = np.arange(len(mine))
            for g, (size, _, words) in enumerate(self.groups):
                if len(kinds) == len(self.groups) == 1:
                    pairs = np.arange(len(key))
                else:
                    pairs = np.flatnonzero((sizes[which] == of) & (self.group[key] == g))
                ends = self._ends(size, [suffixes[i] for i in mine])
                for lo in range(0, len(pairs), CELLS):
                    some = pairs[lo:lo + CELLS]
                    q, r = rank[which[some]], self.place[key[some]]
                    out[some] = self._run((len(some),), ends, words, lambda x, q=q: x[q], lambda x, r=r: x[r])
        return out
