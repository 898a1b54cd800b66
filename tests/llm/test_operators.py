"""Each corpus operator against a brute-force version, and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lucerna.llm import bpe, decontaminate, html, langid, licenses, perplexity, quality, simhash, suffix, wavelet
from lucerna.llm.common import connected_components, held_out, table
from lucerna.llm.queries import TOKENIZERS
from tests.llm.conftest import PASSAGE, ROWS
from tests.oracle import compare

BYTE, WORD = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


def repeated_bytes(texts, length=200):
    where = defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where[t[s:s + length]].append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for spots in where.values():
        if len(spots) > 1:
            for i, s in spots:
                gone[i][s:s + length] = True
    return gone


# ---- op1

def brute_base(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, sf_small, edge, empty):
    docs = table(spark, sf_small, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in perplexity.quality_rules(docs).collect():
        want = brute_base(text[r["doc_id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    got = perplexity.quality_rules(edge)
    assert got.count() == len(ROWS) and got.where("n_words = 0 and kept").count() == 0
    assert perplexity.quality_rules(empty).count() == 0


def test_kneser_ney_sums_to_one():
    keys, _ = perplexity.packed_ngrams(["the cat sat on the mat", "a cat", "", "the hat"])
    distinct, counts = np.unique(keys, return_counts=True)
    model = perplexity.KneserNey(distinct, counts)
    for context in [*(distinct[:5] >> 6), 12345]:
        assert model.probability((int(context) << 6) + np.arange(64)).sum() == pytest.approx(1)
    asked = np.append(distinct[counts > 1].astype(np.int64), [7, 1 << 29])
    assert np.allclose(model.costs(asked), -np.log(model.probability(asked)), atol=1e-6)
    own = distinct[counts == 1].astype(np.int64)  # a text's own n-grams do not vouch for it
    assert (model.costs(own) > -np.log(model.probability(own))).all()


def test_ngram_counts_equal_brute_force(spark, monkeypatch):
    texts = ["The cat. The hat", "a", "", None, "The cat. The hat", "ÄÖ 12\nnext"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    classes = perplexity.symbol_classes()
    want = Counter()
    for t in texts:
        s = [0] * 4 + [int(classes[ord(c)]) for c in t or ""]
        want.update(sum(c << 6 * (4 - j) for j, c in enumerate(s[i:i + 5])) for i in range(len(s) - 4))
    monkeypatch.setattr(perplexity, "MERGE", 3)
    assert {r["key"]: r["n"] for r in perplexity.count_ngrams(df).collect()} == want
    monkeypatch.setattr(perplexity, "LIMIT", 3)  # a larger table is summed up to 4-grams
    small = perplexity.train(df)
    assert small.order == 4 and set(small.grams[0][0].tolist()) == {k & (64 ** 4 - 1) for k in want}


def test_perplexity_rejects_word_salad_and_keeps_clean_text(spark):
    """Planted texts with their words in another order go, what they were made from stays."""
    draw = random.Random(6)
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("lang is not null and doc_id < 4000").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs]
    ordinary = [r for r in rows if len(r[1]) > 800 and re.match(r"\w+[^!|#]*$", r[1]) and len(set(r[1].split())) > 80]
    salad = []
    for i, t, lang in ordinary[::7][:40]:
        words = t.split()
        draw.shuffle(words)
        salad.append((100_000 + i, " ".join(words), lang))
    out = perplexity.quality_rules(spark.createDataFrame(rows + salad, "doc_id long, text string, lang string").repartition(4))
    kept = {r["doc_id"]: r["kept"] for r in out.where("not base_failed").collect()}
    mixed = [kept[i] for i, _, _ in salad if i in kept]
    clean = [kept[i] for i, _, _ in ordinary if i in kept]
    assert len(mixed) >= 35 and sum(mixed) <= 0.1 * len(mixed)
    assert sum(clean) >= 0.99 * len(clean) and len(clean) > 2000


# ---- op2

def test_suffix_removal_equals_brute_force(spark, edge, empty, monkeypatch):
    random.seed(3)
    common = "".join(random.choice("abcd ") for _ in range(420))
    texts = ["".join(random.choice("abcdefgh ") for _ in range(random.randrange(0, 700))) for _ in range(30)]
    texts += [texts[0][:100] + common[:260], common[60:300] + texts[1], common + common, texts[2], "a" * 500, "é" * 150,
              "x" + "é" * 150, common[:199], None, "", *(f"{i:03d}" * 30 + common[100:310] + f"{i * 7:04d}" * 30 for i in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    raw = [(t or "").encode() for t in texts]
    for heavy in (50_000, 3):
        monkeypatch.setattr(suffix, "HEAVY", heavy)
        for r, gone in zip(sorted(suffix.removal_report(df).collect()), repeated_bytes(raw), strict=True):
            t = raw[r["doc_id"]]
            left = bytes(np.frombuffer(t, np.uint8)[~gone])
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            assert tuple(r)[1:] == (len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    assert suffix.removal_report(edge).count() == len(ROWS) and suffix.removal_report(empty).count() == 0
    out = suffix.remove_repeats(edge)
    assert out.columns == edge.columns and out.count() == len(ROWS)
    assert out.where(F.contains("text", F.lit(PASSAGE.strip()))).count() == 0
    assert suffix.remove_repeats(empty).count() == 0


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffix.multikey_quicksort(words)
    assert sorted(map(tuple, words.tolist())) == [tuple(words[i].tolist()) for i in order]


# ---- op3

def test_language_id(spark, edge, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0
    rows = langid.identify(edge).collect()
    assert len(rows) == len(ROWS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in rows if r["doc_id"] in (2, 3, 5, 6, 7))
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and 0 < kept.count() <= len(ROWS) - 5
    assert langid.identify(empty).count() == 0


def test_language_sample_with_a_hot_group(spark):
    """Copies of one text do not crowd a language's other texts out of the sample."""
    rows = [(i, "der gleiche Satz steht hier immer wieder", "de") for i in range(20_000)]
    rows += [(50_000 + i, f"ein anderer Satz mit der Nummer {i} und noch ein Wort", "de") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    want = d.where(~held_out()).select("text").distinct().count()
    got = langid.labelled_sample(d, 800)
    assert got.count() == want and got.select("text").distinct().count() == want


def test_presence_kernel():
    a, b = langid.ngram_set("Abc abd"), langid.ngram_set("abd")
    k = langid.StringKernel.of([a, b])
    got = k.against([a, b])
    assert got[0, 0] == pytest.approx(1) and got[1, 1] == pytest.approx(1)
    assert got[0, 1] == pytest.approx(len(set(a) & set(b)) / np.sqrt(len(a) * len(b)))


# ---- op4

def test_licences(spark, sf_small, edge, empty):
    run = lambda s, d: licenses.recognise(table(s, d, "documents"))
    assert compare(spark, "op4", run, licenses.oracle(), sf_small)[0]
    texts = ["Released under the MIT License.\nx", "x. SPDX-License-Identifier: Apache-2.0", "This program is free software: you can "
             "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version.", "no license here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["licenses"] for r in licenses.recognise(df).orderBy("doc_id").collect()] == ["mit", "apache-2.0", "gpl-3.0", ""]
    assert licenses.recognise(edge).where("licenses = ''").count() == len(ROWS) and licenses.recognise(empty).count() == 0


def test_licences_with_padding(spark):
    """Known sentences with any white space and marks between their words, however long; a reserved right is no licence."""
    texts = ["All  rights\treserved.", "Licensed under the MIT" + " " * 5_000 + "License.",
             "This program is  free \t software; you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
             "option) any later version."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.recognise(d).collect()}
    assert got == {0: (0, ""), 1: (1, "mit"), 2: (2, "gpl-3.0")}


def test_wrapped_licences_in_comments(spark, tmp_path):
    """Whole notices as files carry them: wrapped at 60 columns, behind comment marks, with list numbers and other sentences between."""
    import textwrap

    import duckdb
    whole = {}
    for name, sentences in licenses.TEXTS:
        if len(sentences) > 1 or name in ("isc", "bsl-1.0", "ofl-1.1"):
            whole.setdefault(name, sentences)
    cases, want = [], []
    for name, sentences in whole.items():
        expect = {"x11": "x11"}.get(name, name)
        for mark in ("", "# ", " * ", "// "):
            numbered = [f"{i}. {s}." if i and name.startswith("bsd") else f"{s}." for i, s in enumerate(sentences)]
            paragraphs = ["Copyright (c) 2024 Somebody and others."] + numbered + ["It comes as it is."]
            lines = [mark + x for p in paragraphs for x in [*textwrap.wrap(p, 60), ""]]
            cases.append("\n".join(lines))
            want.append(expect)
    gnu = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
           "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.")
    cases += [gnu, "x = 1  # SPDX-License-Identifier: AGPL-3.0-or-later\nimport x", "MIT License\n\nCopyright\n\n" + textwrap.fill(
        licenses._MIT + ", subject to the following conditions:", 70) + "\n\nReleased under the ISC.\n\n" + textwrap.fill(licenses._MIT_NOTICE + ".", 70)]
    want += ["lgpl-2.1", "agpl-3.0", "mit"]
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.recognise(d).collect()}
    assert [got[i][1] for i in range(len(cases))] == want
    d.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert {r[0]: (r[1], r[2]) for r in con.execute(licenses.oracle()).fetchall()} == got
    assert len({n for n, _ in licenses.rules()}) >= 40


# ---- op5

def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(grams))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i in range(len(fps)):
        low[find(i)].append(ids[i])
    return [min(low[find(i)]) for i in range(len(fps))]


def test_simhash(spark, sf_small, edge, empty):
    docs = table(spark, sf_small, "documents").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in docs]
    want = brute_components([r["doc_id"] for r in docs], fps)
    got = simhash.near_duplicates(table(spark, sf_small, "documents")).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == want
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(ROWS)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({r["component_id"] for r in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_golay_buckets_lose_no_pair_and_runs_are_forests():
    rng = np.random.default_rng(0)
    golay = simhash.Golay()
    u = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        v = u.copy()
        for i in range(len(v)):
            for b in rng.choice(64, bits, replace=False):
                v[i] ^= np.uint64(1) << np.uint64(b)
        (ku, ru), (kv, rv) = simhash.bucket_keys(u, golay), simhash.bucket_keys(v, golay)
        mine = set(zip(ru.tolist(), ku.tolist(), strict=True))
        assert len({r for r, k in zip(rv.tolist(), kv.tolist(), strict=True) if (r, k) in mine}) == len(u)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    near = np.unique(centre ^ sum((np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for _ in range(2)))
    label = simhash.run_forest(near, np.array([0]), np.array([len(near)]))
    a, b = np.nonzero(np.bitwise_count(near[:, None] ^ near[None, :]) <= 3)
    assert (label == simhash._components(len(near), a, b)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == got[200] == 200


# ---- op6

def test_html(spark, sf_small):
    pages = table(spark, sf_small, "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages, pages_per_bucket=7).collect():
        article = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_html_differencing_and_edges(spark):
    line = "<div>Site menu</div><div>{}</div><div>Copyright notes of the site</div>"
    rows = [(i, f"http://h.example/a/{i}", line.format(f"Own text {i} &amp; more")) for i in range(9)]
    rows += [(20, None, None), (20, None, None), (21, "http://x.example/", ""), (None, "http://h.example/a/3", line.format("Third")),
             (30, "http://one.example/p", "<nav>m</nav><main><p>a <b>b</b>\n c</p><script>x</script><p>d</main><form>f</form>"),
             (31, "x", "<p>a <! b < c <3 &lt;i&gt;<a href='q\">z</a><p>" + "long " * 50_000)]
    df = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, url string, html string, text string")
    for size in (2, 1000):
        got = html.extract(df, pages_per_bucket=size).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r for r in got}
        assert all(by[i]["text"] == f"Own text {i} & more" and by[i]["n_shared"] == 2 for i in range(9))
        assert by[20]["text"] == "" and by[30]["text"] == "a b c\n\nd"
    assert html.extract(df.limit(0)).count() == 0


def test_html_of_one_hot_path(spark):
    """Pages that differ only in the query string are dealt out over many buckets, with the same result."""
    line = "<div>Site menu</div><div>{}</div><div>Copyright notes of the site</div>"
    df = spark.createDataFrame([(i, f"http://h.example/index.php?id={i}", line.format(f"Own text {i}")) for i in range(-60, 60)],
                               "page_id long, url string, html string").repartition(3)
    places = df.select(F.concat_ws("\x01", F.lit("h.example"), F.lit("/index"), F.lpad(F.hex("page_id"), 16, "0")).alias("place"))
    assert len(html._splitters(places, 2)) > 20
    for size in (2, 1000):
        got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(df, pages_per_bucket=size).collect()}
        assert got == {i: (f"Own text {i}", 2) for i in range(-60, 60)}


def test_shared_lines_is_a_longest_common_subsequence():
    random.seed(5)
    for _ in range(200):
        a, b = ([random.randrange(5) for _ in range(random.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)


# ---- op7

def test_decontamination(spark, sf_small, edge, empty, monkeypatch):
    docs, bench = table(spark, sf_small, "documents"), table(spark, sf_small, "benchmark")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    got = {r["doc_id"]: r for r in decontaminate.find_contaminated(docs, bench).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["item_ids"] == sorted(i for i, t in items.items() if t in (r["text"] or ""))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    blocks = decontaminate.find_contaminated(docs, bench)
    assert sorted((r["doc_id"], r["item_ids"]) for r in blocks.collect()) == sorted((d, r["item_ids"]) for d, r in got.items())
    item = "Which animal runs away from the angry farmer when the lazy dog barks at night? The quick brown fox does."
    changed = "so " * 70 + item.replace("angry", "cross").replace("night", "noon") + " end" * 50
    q = spark.createDataFrame([(5, item), (5, item), (6, None), (None, "x y"), (7, "")], "item_id long, text string")
    d = edge.limit(0).unionByName(edge).unionByName(spark.createDataFrame([(99, changed, "en", "z", 1, 0.0, "", 1, "")], edge.schema))
    found = decontaminate.find_contaminated(d, q).where("contaminated").collect()
    assert [(r["doc_id"], r["item_ids"]) for r in found] == [(99, [5])]
    clean = decontaminate.keep_clean(d, q)
    assert clean.columns == edge.columns and clean.count() == len(ROWS)
    assert decontaminate.find_contaminated(empty, q).count() == 0
    assert decontaminate.find_contaminated(edge, q.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_hot_items(spark, sf_small):
    """Items in a third of all rows: as copies of one text, as a shared passage, and of everyday words."""
    docs = table(spark, sf_small, "documents").select("doc_id", "text").where("doc_id is not null").limit(300).collect()
    copied = "Which river runs past the old mill before it meets the northern sea? The Ostra does, after ninety miles."
    passage = "Name the tallest of the seven towers that the masons built in Velmar. It is the tower of the bell founders."
    common = Counter(w for r in docs for w in set(re.findall(r"[a-z]+", (r["text"] or "").lower())))
    usual = " ".join(w for w, _ in common.most_common(24))
    rows = [(i, r["text"] or "") for i, r in enumerate(docs)]
    n = len(rows)
    rows += [(10_000 + i, f"{docs[0]['text']} {copied}") for i in range(n)]
    rows += [(20_000 + i, f"{t[:400]} {passage} {t[400:900]}") for i, t in rows[:n]]
    rows += [(30_000, f"{rows[1][1][:300]} {usual} {rows[1][1][300:600]}")]
    q = spark.createDataFrame([(1, copied), (2, passage), (3, usual)], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_contaminated(d, q).collect()}
    want = {i: [k for k, x in ((1, copied), (2, passage), (3, usual)) if x in t] for i, t in rows}
    assert all(set(w) <= set(got[i]) for i, w in want.items())
    assert all(set(got[i]) & {1, 2} == set(w) & {1, 2} for i, w in want.items())


def test_decontamination_of_any_length_and_many_items(spark):
    """Verbatim items of 4 to 900 words, short ones among other benchmark words, and a benchmark of 5,000 items."""
    draw = random.Random(3)
    words = [f"w{i:05d}" for i in range(20_000)]
    items = [" ".join(draw.sample(words, draw.randint(15, 59))) for _ in range(4_990)]
    items += [" ".join(draw.sample(words, n)) for n in (4, 5, 6, 8, 10, 120, 330, 500, 700, 900)]
    leaks = [*range(0, 4_990, 50), *range(4_990, 5_000)]
    rows = [(k, " ".join([*draw.choices(words, k=150), items[k], *draw.choices(words, k=150)])) for k in leaks]
    rows += [(10_000 + i, " ".join(draw.choices(words, k=300))) for i in range(100)]
    q = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_contaminated(d, q).collect()}
    assert got == {d: [d] if d < 5_000 else [] for d, _ in rows}


def reworded(text, draw, words, share=0.2):
    """An item with its sentences in another order and a share of its words replaced."""
    sentences = [x for x in re.split(r"(?<=[.!?:])\s+|\n", text) if x]
    draw.shuffle(sentences)
    return " ".join(draw.choice(words) if draw.random() < share else w for x in sentences for w in x.split())


def planted_paraphrases(spark, sf_small):
    """Clean documents, each with one reworded item of the benchmark."""
    draw = random.Random(4)
    bench = table(spark, sf_small, "benchmark")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = [r["text"] for r in table(spark, sf_small, "documents").where("length(text) > 1200").orderBy("doc_id").collect()]
    hosts = [t for t in texts if not any(x in t for x in items.values())]
    words = [w for t in hosts for w in t.split()]
    rows = []
    for i, k in enumerate(sorted(items)):
        host = hosts[i % len(hosts)]
        at = host.find(" ", draw.randrange(100, len(host) - 200))
        rows.append((k, f"{host[:at]} {reworded(items[k], draw, words)} {host[at:]}"))
    rows += [(10_000 + i, t) for i, t in enumerate(hosts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench, len(items)


def test_paraphrases_are_found(spark, sf_small):
    docs, bench, n = planted_paraphrases(spark, sf_small)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert sum(k in found for k, found in got.items() if k < 10_000) >= 0.9 * n
    assert not [k for k, found in got.items() if k >= 10_000 and found]


def test_the_latent_space_decides(spark, sf_small, monkeypatch):
    """With one random direction in place of the space, the recall of the test above is not reached."""
    docs, bench, n = planted_paraphrases(spark, sf_small)
    one = lambda numbers, groups, s: [decontaminate.random_directions(g, 1, 1) for g in groups]
    monkeypatch.setattr(decontaminate, "latent_spaces", one)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert sum(k in found for k, found in got.items() if k < 10_000) < 0.9 * n


def test_latent_spaces_hold_the_items(spark, sf_small):
    """The decomposition is that of blocks and items: the items keep their lengths in their space."""
    bench = table(spark, sf_small, "benchmark")
    items = decontaminate.Items.of([(r["item_id"], r["text"]) for r in bench.collect()])
    weight = np.ones(len(items.vocabulary), np.float32)
    s = decontaminate.Settings(rank=2 * len(items.ids))
    (g,) = decontaminate.groups_of(items, weight, s)
    docs = [(i, i, w.tobytes()) for i, w in enumerate(items.words)]
    numbers = spark.createDataFrame(docs, "doc_id long, key long, words binary").repartition(3)
    (basis,) = decontaminate.latent_spaces(numbers, [g], s)
    rows = decontaminate.item_rows(g)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    assert (np.linalg.norm(rows @ basis, axis=1) > 0.97 * np.linalg.norm(rows, axis=1)).all()


# ---- op8

def test_bpe_equals_the_library(spark, sf_small, edge, empty):
    lib = Tokenizer.from_file(BYTE)
    docs = table(spark, sf_small, "documents").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    texts = Counter(r["text"] or "" for r in docs.collect())
    rows = bpe.round_trip(docs, BYTE).collect()
    assert Counter(r["decoded"] for r in rows) == texts
    for r in rows:
        assert r["ids"] == lib.encode(r["decoded"], add_special_tokens=False).ids
    r = bpe.digests(bpe.round_trip(edge.where("doc_id = 7"), BYTE)).first()
    ids = lib.encode(ROWS[7][1], add_special_tokens=False).ids
    assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256(ROWS[7][1].encode()).hexdigest())
    assert bpe.round_trip(empty, BYTE).count() == 0


# ---- op9

def test_quality_classifier(spark, edge, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.predicted == got.quality).mean() > 0.9
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(edge, labels.limit(0)).where("score <> 0.5").count() == 0


def test_quality_sample_weighs_copies(spark):
    """A hot group among the labelled rows is one weighted row: both labels stay in the fit."""
    good = [(i, f"A sensible sentence number {i}, with words of many kinds in it. It ends well.") for i in range(300)]
    bad = [(1000 + i, f"### {i} $$$ || <x> {i} {i} {i} ###") for i in range(300)]
    hot = [(5000 + i, "### 1 $$$ || <x> 1 1 1 ###") for i in range(1500)]
    docs = spark.createDataFrame(good + bad + hot, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad + hot], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert min(out[i] for i in range(300)) > 0.6 and max(v for i, v in out.items() if i >= 1000) < 0.3
    model = quality.fit(quality.features(docs), labels, sample=100)
    assert model is not None and len(model.roots)


def test_held_out_is_crc32_mod_5(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# ---- op10

def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 8), (1, 8), (5000, 700), (1300, 3)):
        v = rng.integers(0, top, n).astype(np.uint16)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(v, 10).to_bytes())
        assert (m.all() == v).all()
        for i in range(0, n, 97):
            assert m.access(i) == v[i] and m.count(int(v[i]), i) == (v[:i] == v[i]).sum()
        for x in (0, 1, 5, 1023, 5000):
            assert m.count(x) == (v == x).sum() and m.locate(x) == np.flatnonzero(v == x).tolist()


def test_single_tokens_are_read_without_unpacking_the_shard():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 900, 1_000_000).astype(np.uint16)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(v, 10).to_bytes())
    assert m.access(250_000) == v[250_000] and m.count(7, 300_000) == (v[:300_000] == 7).sum()
    assert sum(len(p.open) for p in m.planes) < 10 * 4 < sum(len(p.ends) for p in m.planes)
    assert m.locate(899) == np.flatnonzero(v == 899).tolist()


def test_words_of_equal_hash_are_told_apart():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64 for every base."""
    lib, encoder = Tokenizer.from_file(WORD), wavelet.WordEncoder(WORD)
    pairs = []
    for n in (1024, 2048):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        pairs += [a, a.translate(str.maketrans("ab", "ba"))]
    for texts in (pairs, [f"one {pairs[1]} two", "three", f"{pairs[0]} four", "five six"], pairs[::-1]):
        got = encoder.encode_many(texts)
        assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_index(spark, sf_small, edge, empty):
    lib = Tokenizer.from_file(WORD)
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    start = 0
    for d, r in zip(docs.orderBy("doc_id").collect(), wavelet.token_index(docs, WORD, shard_tokens=5000).orderBy("start").collect(), strict=True):
        ids = [*lib.encode(d["text"], add_special_tokens=False).ids, 2]
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = wavelet.token_index(edge, WORD).orderBy("start").collect()
    want = sorted(len(lib.encode(t[1] or "", add_special_tokens=False).ids) + 1 for t in ROWS)
    assert sorted(r["n_tokens"] for r in rows) == want and rows[0]["doc_id"] is None
    assert wavelet.token_index(empty, WORD).count() == 0


def test_word_encoder_on_odd_characters():
    random.seed(1)
    pick = lambda: chr(random.choice([random.randrange(1, 0x300), random.randrange(0x300, 0xD7FF), random.randrange(0xE000, 0x1FFFF),
                                      32, 10, 97, 116, 0x1C, 0x85, 0xA0, 0x2028, 39, 115, 0x3A3, 0x130, 0x301, 48]))
    texts = ["".join(pick() for _ in range(60)) for _ in range(500)] + ["", "'s", "0 0 a0b", "ΟΔΟΣ", "<|endoftext|> a"]
    lib = Tokenizer.from_file(WORD)
    for t, got in zip(texts, wavelet.load(WORD).encode_many(texts), strict=True):
        assert got.tolist() == lib.encode(t, add_special_tokens=False).ids
