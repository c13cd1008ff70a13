import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def prose():
    """Seeded texts of invented words."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubdfklmnprst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def make(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """A frame of documents with columns whose names the operators use inside."""

    def make(texts, parts=3, ids=None, langs=None, sources=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [
            (ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t), f"c{i}", i, 0.5, "x")
            for i, t in enumerate(texts)
        ]
        schema = DOC_SCHEMA + ", chunk string, found int, guess double, rest string"
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
