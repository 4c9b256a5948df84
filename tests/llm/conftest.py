import random

import pytest

WORDS = "the of and river stone green light over under winter garden letter number paper music window market bridge island summer".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank, short, very long, equal and repeated texts, and extra columns with clashing names."""
    long = prose(1, 60_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (5, long), (6, prose(2, 80)), (7, prose(2, 80)), (7, prose(2, 80)), (8, prose(2, 80) + " tail"), (None, prose(3, 20)), (9, "12 34 !?"), (10, "naïve café <|endoftext|> x y  z")]
    extra = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, component_id int, label string, sig int, rep int, a int, piece string, ids string, row int, terms int, html int, __h int"
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else None, None, None, "s", "k", 1, "l", 1, 1, 1, "p", "i", 1, 1, 1, 1) for d, t in rows], extra)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id = -1")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
