import random

import pytest

LONG = "lorem " * 30_000


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): null, empty, blank and long texts, case, other scripts, copies, near copies, repeated rows, no id."""
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(6)]
    near = base[0].split()
    near[30] = "changed"
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "One two"), (6, "one TWO"), (7, "Ärger größer straße 漢字 😀 naïve."), (8, "1234 !!! ---"), (None, base[3]), (None, None)]
    rows += [(10 + i, t) for i, t in enumerate(base)] + [(20, base[0]), (21, " ".join(near)), (22, base[0].upper()), (22, base[0].upper()), (23, base[1] + " " + base[2])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with what operators make."""
    rows = [(i, t, "en" if k % 2 else "fr", f"s{k % 3}", k, 1.5, "x", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, row string, k0 long").repartition(3, "n_words")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
