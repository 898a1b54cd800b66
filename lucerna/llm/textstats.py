"""Exact per-document counts on UTF-8 bytes (words are runs without ASCII white space)."""

from __future__ import annotations

from collections import Counter

SYMBOLS = b"#*$%&|<>"  # fixed value
SPACES = b" \t\n\r\x0b\x0c"  # fixed value: the bytes 0x20 and 0x09-0x0D


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words lying in a window of ``size`` words that is found twice or more."""
    grams = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    total, covered = 0, 0  # covered: end of the words counted so far
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            total += at + size - max(at, covered)
            covered = at + size
    return total


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    spaces = len(text) - len(text.translate(None, SPACES))
    return (len(words), code_points(text) - spaces, len(text) - len(text.translate(None, SYMBOLS)),
            duplicate_lines(text), repeated_words(words))
