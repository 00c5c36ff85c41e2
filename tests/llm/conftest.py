import hashlib

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
WORDS = "amber basin cedar delta ember fjord grove haven islet juniper kelp lagoon meadow north orchid pebble quarry ridge stone timber upland valley willow zephyr".split()


def prose(seed, n):
    """``n`` words that depend on the seed alone."""
    out, state = [], hashlib.sha256(str(seed).encode()).digest()
    while len(out) < n:
        out += [WORDS[b % len(WORDS)] + "aeiouy"[b // 43] for b in state]
        state = hashlib.sha256(state).digest()
    return " ".join(out[:n])


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose("long", 30_000)
    return documents([(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, long), (6, long + " more"), (7, "a" * 5000), (8, "é" * 300 + "<|endoftext|>"), (8, "other text")])


@pytest.fixture
def nothing(documents):
    return documents([])
