from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, kind string, cls string, size string, tile string, rid string, toxic_score string"


@pytest.fixture(scope="session")
def sentences():
    """Invented prose: n words from a small vocabulary, reproducibly."""

    def make(seed: int, n: int, words: int = 4000) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_frame(spark):
    """A documents table with clashing extra columns from (id, text[, lang]) rows."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "k", "0", "c", "1", "t", "r", "x") for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts(sentences):
    """Null, empty, white space, one word, very long, a huge word, repeated rows, other scripts."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, sentences(1, 30000)), (6, "x" * 300000), (7, "same text here for all of us"), (7, "same text here for all of us"), (8, "日本語のテキスト ёж 😀 é"), (9, "a b c d")]
