import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, kept string, size long, block int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows every operator must take: nulls, empty, very long, ties, repeated rows, and columns named like inner ones."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    base = " ".join(f"b{rng.randrange(10 ** 6)}" for _ in range(120))
    near = base.replace(base.split()[5], "changed")
    rows = [(1, None), (2, ""), (3, "one"), (4, "two words"), (5, long), (6, passage + " tail one"), (7, "head " + passage), (8, base), (9, base), (9, base),
            (10, near), (11, near.upper()), (12, "\t\n\x0b\x0c\r "), (13, "é ü — ß"), (14, "same same same same same same"), (None, "no id " + passage),
            (15, "line\nline\nother\nline"), (16, " ".join(["x"] * 200))]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in (3, 4) else f"s{(i or 0) % 3}", None, "clash", "clash", -1, -1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
