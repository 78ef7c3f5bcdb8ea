import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("score", "n", "g", "key", "range", "host", "bucket", "shard", "evidence", "item", "piece")]
)


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("ola", "Ted", "miru", "sant", "bel", "kor", "ähre", "île", "don't", "x1", "the", "and", "of.", "to,")) + rng.choice("abcdefgh") for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows, shared passages, odd characters."""
    rng = random.Random(5)
    passage = words(rng, 20)
    base = words(rng, 200)
    near = base.replace(base.split()[50], "other", 1)
    texts = [
        None, "", " ", "a", base, base, near, base + " " + passage, passage + " end", "x" * 60 + "y" * 60, "x" * 120, words(rng, 60_000), "ab " * 3000, "é" * 40 + "ü" * 40, "é" * 40 + "ß", "\x00\n\t\r\n  ▁ ▁▁x", "<|endoftext|> you IDIOT!! y0u st*pid",
        passage.upper(), "  lead and trail  ", "\n\n", "中文 😀 𝔘", *[words(rng, rng.randint(1, 40)) for _ in range(25)],
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), *["z"] * 11) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (7, "same id, other text " + passage, "en", "s1", 5, *["z"] * 11), (None, base, None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1 if i in (16, 20, 22, 25) else 0) for i in range(45)] + [(None, 1, 1), (3, None, None), (999, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
