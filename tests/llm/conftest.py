import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus():
    """Rows that are hard to get right, and random ones: (doc_id, text)."""
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "naïve", "x" * 40, "#$%", "日本", "don't"]
    rows = [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one two"), (12, "Alpha beta GAMMA delta"), (13, "alpha BETA gamma delta")]
    rows += [(14, "a b c d e f g h i j " * 400), (15, "tail " * 9000), (16, "\x85 \xa0   x\x1cy")]
    for i in range(60):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(1, 300))]
        rows.append((100 + i, "".join(w + pick.choice([" ", " ", "\n", "  "]) for w in words)))
    rows += [(200 + i, rows[20 + i][1]) for i in range(5)]  # copies
    rows += [(300 + i, rows[30 + i][1] + " end") for i in range(5)]  # near copies
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names clash with those that operators use."""
    rows = [(i, t, "s", i % 3, "n", i, i) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, a string, length long, n long").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
