import pytest

#: Rows with what upsets operators: nulls, empty and blank texts, copies, a very long text, odd characters.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away home"),
    (2, "the quick brown fox jumps over the lazy dog and runs away home"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "Licensed under CC BY-NC 4.0.  All rights reserved."),
    (7, "naïve café déjà vu \U0001f600 über straße"),
    (8, "word " * 9000),
    (9, "a"),
    (9, "a"),
    (None, "nobody knows this id"),
    (11, "<|endoftext|> İstanbul ΑΣ \x00\x1f x"),
]


@pytest.fixture
def odd(spark):
    """doc_id, text, lang, source, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 4}", 5, "x", 1.5, "y", 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, target string, shard double, fp string, _size int")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
