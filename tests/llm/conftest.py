import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, words string, kept boolean, body string, id string"


def prose(rng, n):
    return " ".join(rng.choice(["ba", "co", "du", "fe", "gi"]) + rng.choice(["lan", "mer", "nos", "pit", "rux", "tav"]) + str(rng.randrange(40)) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", None, "y", "z") for i, t, s in rows], SHAPE)


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    base, passage, line = prose(rng, 200), prose(rng, 70), "All rights of this site are kept by its owners"
    out = [(1, base, "a"), (2, base, "b"), (3, base.replace(base.split()[50], "other", 1), "a"), (4, None, "a"), (5, "", None), (6, "   \n\t ", "a"), (7, "One", "a"), (None, prose(rng, 60), "a"), (8, "spam " * 300, "a")]
    out += [(10 + k, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "c") for k in range(6)]
    out += [(20, prose(rng, 30_000), "a"), (21, "É" * 5000 + " " + prose(rng, 20), "b"), (22, "x" * 200_000, "b")]
    out += [(30 + k, "\n".join([prose(rng, 15), line, prose(rng, 15)]), "host") for k in range(30)]
    out += [(70 + k, line, "host") for k in range(3)]
    out += [(90, "repeated row " + base[:300], "a"), (90, "repeated row " + base[:300], "a"), (91, "same id " + prose(rng, 60), "a"), (91, "another text " + prose(rng, 60), "a")]
    return out


@pytest.fixture(scope="session")
def odd(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
