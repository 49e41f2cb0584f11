import random

import pytest

CLASHING = "k string, h string, n string, size string, line string, rank string, words string, taken string"


def text_of(rng, n, lines=False):
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "river", "stone", "été", "ñandú", "run", "x1", "a,b", "Done."]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.6 else ""))
    text = " ".join(out)
    if lines:
        text = "".join("\n" if c == " " and rng.random() < 0.12 else c for c in text)
    return text


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, and one key for two texts."""
    rng = random.Random(3)
    long = text_of(rng, 30_000, True)
    plain = text_of(rng, 120, True)
    return [
        (1, plain, "a"), (1, plain, "a"), (2, plain, None), (3, "", "a"), (4, None, "b"), (5, " \n\t ", "b"), (None, plain, "a"),
        (None, None, None), (6, long, "c"), (7, long, "c"), (8, "one", "c"), (9, text_of(rng, 80, True), "b"), (9, text_of(rng, 80, True), "b"),
        (10, "x" * 5000, "a"), (11, "\n" * 50, "a"), (12, "😀 漢字 \x00 \r\n ▁ end", "b"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    extra = ("z",) * 8
    return spark.createDataFrame([r + extra for r in edge_rows], f"doc_id long, text string, source string, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
