import random

import pytest

from memspark.sources.scratch import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, kept int, node int, part int, key int, quality string"


def make(spark, rows):
    """Documents with columns whose names operators use themselves."""
    full = [(i, t, "en", s, len(t) if t else 0, 7, "x", 5, 1, 2, 3, "q") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words))


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = prose(1, 60)
    near = base.replace(" ", "  ", 3) + " tail"
    return [
        (1, base, "a"),
        (2, near, "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n\v\f\r ", "b"),
        (6, "one two three", "a"),
        (7, "One TWO three", None),
        (8, prose(2, 30_000), "c"),
        (9, "x" * 50_000, "c"),
        (10, base, None),
        (10, base, None),
        (11, "a b c d e f g h i j k l", "é"),
        (12, "A\x0bb c\x1cd e é 漢字 🙂 \x00 end", "é"),
        (12, "another text of the same id", "é"),
        (None, base.upper(), "a"),
        (None, "a text without id or partner in this table at all", None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture
def space(spark):
    own = Workspace(spark)
    yield own
    own.clear()
