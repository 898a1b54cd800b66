"""Locally consistent parsing: its promises, and the query against a plain loop over all documents."""

import hashlib
import random

import numpy as np
import pytest

from lucerna.llm import parsing
from lucerna.llm.common import table


def plain_colours(names):
    """Deterministic coin tossing, one name after the other."""
    toss = lambda a, b: next((2 * i + (a >> i & 1) for i in range(64) if (a ^ b) >> i & 1))
    colour = list(names)
    for _ in range(4):
        colour = [toss(c, colour[i - 1] if i else c ^ 1) for i, c in enumerate(colour)]
    for high in (5, 4, 3):
        for i, c in enumerate(list(colour)):
            if c == high:
                near = colour[i - 1:i] * (i > 0) + colour[i + 1:i + 2]
                colour[i] = min({0, 1, 2} - set(near))
    return colour


def test_colours_equal_a_plain_loop():
    rng = np.random.default_rng(0)
    sequences = [[int(v) for v in s[np.concatenate([[True], s[1:] != s[:-1]])]]
                 for s in (rng.integers(0, 2 ** 62 if i % 2 else 5, n).astype(np.uint64) for i, n in enumerate((1, 2, 3, 9, 300, 1000)))]
    names = np.array([v for s in sequences for v in s], np.uint64)
    first = np.cumsum([0] + [len(s) for s in sequences[:-1]])
    got = parsing.colours(names, first)
    assert got.tolist() == [c for s in sequences for c in plain_colours(s)]
    assert got.max() <= 2
    for lo, s in zip(first, sequences, strict=True):
        part = got[lo:lo + len(s)]
        assert (part[1:] != part[:-1]).all()


def test_equal_substrings_share_interior_phrases():
    """Whatever stands before it, a passage has the same phrases but for a few names at its ends, on every level."""
    random.seed(2)
    passage = "".join(random.choice("abcdefgh ") for _ in range(4000))

    def levels(text):
        names, first, at = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]), np.arange(len(text) + 1)
        out = []
        while len(names) > 1:
            names, first, at = parsing.phrases(names, first, at)
            out.append((names, at))
        return out
    for before in ("x", "some words before ", "".join(random.choice("xyz ") for _ in range(777))):
        for level, ((a, at), (b, bt)) in enumerate(zip(levels(passage), levels(before + passage + " end"), strict=False), 1):
            own = set(zip(at[:-1].tolist(), a.tolist(), strict=True))
            other = set(zip((bt[:-1] - len(before)).tolist(), b.tolist(), strict=True))
            lost = sorted(p for p, _ in own - other)
            edge = 20 * 4 ** level  # at most four code points a name and level, a few names at either end
            assert all(p < edge or p > len(passage) - edge for p in lost)
            if level <= 3:
                assert len(own & other) > 0.5 * len(own)


def test_phrases_do_not_depend_on_the_other_texts():
    texts = ["", "a", "aaaaaaaaaa", "abababab", "the cat sat on the mat " * 30, "ünïcödé 😀 " * 5, "x", "the cat sat on the mat",
             "ends in aa", "aa begins", "  ", "  x"]
    together = parsing.fingerprints(texts)
    assert (together == np.concatenate([parsing.fingerprints([t]) for t in texts])).all()
    assert len({m.tobytes() for m in together}) == len(texts) and not together[0].any()


def test_likeness():
    random.seed(5)
    words = lambda n: " ".join("".join(random.choice("abcdefghijklm") for _ in range(random.randrange(2, 9))) for _ in range(n))
    a, b = words(800), words(800)
    marks = parsing.fingerprints([a, b, a[:len(a) // 2] + b[:len(b) // 2], a, "", "", "In. " * 500, parsing.edited_text("In. " * 500, a)])
    like = lambda i, j: parsing.likeness(marks[i:i + 1], marks[j:j + 1])[0]
    assert like(0, 3) == 1 and like(4, 5) == 1 and like(0, 4) == like(4, 0) == 0
    assert like(0, 1) < 0.1 and 0.2 < like(0, 2) < 0.5 and like(6, 7) > like(6, 0) + 0.1


def brute(rows):
    """The query's rows by a loop over all documents in order."""
    distinct = sorted({(d is None, d or 0, t or "") for d, t in rows})
    texts = [t for _, _, t in distinct]
    out = []
    for i, (none, d, t) in enumerate(distinct):
        after = texts[(i + 1) % len(texts)]
        changed = parsing.edited_text(t, after)
        own, other, following = parsing.fingerprints([t, changed, after])
        row = (None if none else d, len(t), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(),
               float(parsing.likeness(own[None], other[None])[0]), float(parsing.likeness(own[None], following[None])[0]))
        out += [row] * sum((x is None, x or 0, y or "") == (none, d, t) for x, y in rows)
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [1 << 20, 2_000])
def test_query_equals_brute_force(spark, sf_small, monkeypatch, piece):
    monkeypatch.setattr(parsing, "PIECE", piece)
    docs = table(spark, sf_small, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, parsing.compare_with_edits(docs.repartition(5)).collect()), key=str) == want


def test_edges_and_hot_ids(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    ids = {d for d, _ in rows}
    got = parsing.compare_with_edits(edge).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == ids
    # documents with an id of their own: the order is that of the ids
    single = [(d, t) for d, t in rows if [x for x, _ in rows].count(d) == 1 and d is not None]
    df = spark.createDataFrame(single, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, parsing.compare_with_edits(df).collect()), key=str) == brute(single)
    assert parsing.compare_with_edits(empty).count() == 0
    one = parsing.compare_with_edits(edge.where("doc_id = 12")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    # a third of the rows are one document, and one id has many texts
    hot = [(5, "the same text again and again")] * 400 + [(6, f"text number {i} of one id") for i in range(300)] + [(i, f"other {i}") for i in range(7, 400)]
    df = spark.createDataFrame(hot, "doc_id long, text string").repartition(6)
    out = parsing.compare_with_edits(df).collect()
    assert len(out) == len(hot) and len({tuple(r) for r in out if r["doc_id"] == 5}) == 1
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 6}) == 300


def test_fingerprint_keeps_other_columns(spark, edge):
    out = parsing.fingerprint(edge)
    assert out.count() == edge.count() and {"lang", "key"} <= set(out.columns)
    assert out.where("doc_id = 2").first()["fingerprint"] == "0" * 272
