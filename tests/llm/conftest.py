import random

import pytest


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size):x}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, markup, long, repeated and non-ASCII texts."""
    rng = random.Random(3)
    long = words(rng, 6000, 5000)
    return [None, "", " ", "\n\t", "a", "Ünïcödé x", "日本 語 \U0001f600 text", "a b c d", long, long, "x" * 30000, "\x00 nul", "A. B! C?\nD", words(rng, 80), words(rng, 80) + "."]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts with a null and a repeated id, and columns whose names clash with what operators add."""
    rows = [(None if i == 5 else i, t, "en" if i % 2 else None, "s", len(t or ""), "kept", 1.5) for i, t in enumerate(odd_texts)]
    rows.append(rows[8])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, shard double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
