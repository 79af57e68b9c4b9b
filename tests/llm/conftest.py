import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, shard int, size string, spans string, n_words string, license string, item_id long, kept string, words string, seed string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def document_rows():
    """Nulls in each column, empty, blank and very long texts, repeated rows, copies, near copies, odd characters."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    long = prose(rng, 20_000)
    base = prose(rng, 100).split()
    texts += [None, "", " \n\t ", "one two", "a" * 150_000, long, long, "é ß Σ İ 日本 😀  \x1c", "x\n" * 50]
    texts += [texts[0], texts[0]]
    for k in range(6):
        near = list(base)
        near[10 + k * 9] = f"word{k}"
        texts.append(" ".join(near))
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None), (None, None, None, "src0", 3)]
    return [(*r, 0.5, "n", 7, "s", "p", "w", "l", 9, "k", "q", "e") for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
