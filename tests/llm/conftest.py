from __future__ import annotations

import pytest

ODD = ["", " ", "\n\t  ", "a", "one two", "It's 'll don''t  x\n\n y <|endoftext|> z<|startoftext|>", "ΣΑΣ ß İ ﬁ é日本 🙂 １２", "x" * 3000, "word " * 9000, "same text here now", "same text here now"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, odd texts, a repeated row, and extra columns whose names operators use inside."""
    rows = [(i, t, "en", "s", 1, "k", 2, 3.0) for i, t in enumerate(ODD)]
    rows += [(50, None, None, None, None, None, None, None), (None, "no key", "en", "s", 1, "k", 2, 3.0), (3, "a", "en", "s", 1, "k", 2, 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, id long, n double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
