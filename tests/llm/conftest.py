import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, fp long, key string"
LONG = " ".join(f"word{i % 97} and of the{i}" for i in range(30_000))
PASSAGE = "the same long passage stands in several of the documents of this table, word for word, and it has well over two hundred bytes, so that it must be found wherever it starts and whatever stands before it or after it. "
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer again", "en", "a"),
    (2, "", "en", "a"), (3, None, "en", None), (None, "kein einziger Hund ist heute im Garten, und der Fuchs auch nicht", "de", "a"),
    (5, None, None, None), (6, "   \n\t ", None, "b"), (7, "123 456 !!! 789", "en", "b"), (8, LONG, "en", "b"),
    (9, "le renard brun saute par-dessus le chien paresseux et s'en va dans la forêt avec élégance", "fr", "b"),
    (10, PASSAGE + "Then this one ends.", "en", "c"), (11, "Another start. " + PASSAGE, "en", "c"),
    (12, "ünïcödé " * 40 + PASSAGE[:150], "de", "c"), (13, "ünïcödé " * 40 + "x", "de", "c"),
    (14, "<|endoftext|> it's we'll  ok 0 00　x ²", "en", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeats, and columns named like the operators' own."""
    rows = [(*r, len(r[1] or ""), 0.5, "x", 7, "k") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
