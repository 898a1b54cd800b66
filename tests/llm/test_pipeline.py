"""The pipeline stage by stage against brute force."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lucerna.llm.common import saved, table
from lucerna.llm.queries import TOKENIZERS
from tests.llm.test_operators import brute_components, brute_fingerprint, repeated_bytes


def test_stages(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], sf_small), name))
        assert name == "encoding" or tables[-1].columns == columns
    first, identified, single, cut, clean = ({r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:5])
    assert len(identified) == len(first)  # all are in a learned language
    ids = sorted(identified)
    assert set(single) == set(brute_components(ids, [brute_fingerprint(identified[i]) for i in ids]))
    ids = sorted(single)
    for i, gone in zip(ids, repeated_bytes([single[i].encode() for i in ids]), strict=True):
        left = bytes(np.frombuffer(single[i].encode(), np.uint8)[~gone])
        assert len(left) <= len(cut[i].encode()) <= len(left) + 6 * (1 + int((np.diff(gone.astype(int)) == 1).sum()))
        assert left.decode(errors="ignore") in cut[i] or gone.any()
    items = [r["text"] for r in table(spark, sf_small, "benchmark").collect()]
    assert set(clean) == {i for i, t in cut.items() if not any(x in t for x in items)}
    lib = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    got = {r["doc_id"]: r["ids"] for r in tables[5].collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in clean.items()}


def test_run_on_an_empty_table(spark, sf_small):
    docs = table(spark, sf_small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 0


def test_saved_leaves_no_shuffle_files(spark):
    """The shuffle files of a written table go with the write; the setting is put back."""
    import time

    from lucerna.llm.common import saved
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        names = (blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size()))
        return {n for n in names if n.startswith("shuffle_")}
    was = spark.conf.get(name)
    before = shuffles()
    saved(spark.range(5000).selectExpr("id % 97 AS k").groupBy("k").count(), "test-shuffle")
    assert spark.conf.get(name) == was
    for _ in range(40):
        if not shuffles() - before:
            break
        time.sleep(0.25)
    assert not shuffles() - before
