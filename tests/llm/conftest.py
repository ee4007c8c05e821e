import pytest

LONG = "word " * 30_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nA shared line that many documents hold.\n", "en", "a"),
    (2, "  A SHARED line that many documents hold.\t\nSecond line here, which is different from others.", "en", "b"),
    (3, "A shared line that many documents hold.", "en", None),
    (4, None, None, "a"),
    (5, "", "fr", "b"),
    (6, " \n\t\n", "fr", "a"),
    (7, LONG, "en", "a"),
    (8, "é ñ ü ß 日本語 🙂 \x00 ​", "de", "c"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today.\nA shared line that many documents hold.\n", "en", "a"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today.\nA shared line that many documents hold.\n", "en", "a"),
    (None, "A document without an id, whose text is not empty.", "en", "a"),
    (10, "</s>[INST] <|endoftext|> <|im_start|> \\ [/INST]", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators might use themselves."""
    rows = [(i, t, x, s, len(t or ""), 1, "k", [0], 0.5) for i, t, x, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 int, lines string, drop array<int>, score double").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
