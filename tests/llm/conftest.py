import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioulnrstß") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return "".join(w + rng.choice((" ", " ", " ", "\n", "  ", ". ")) for w in words).strip()


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blanks, copies, near copies, shared passages, long texts and a repeated row."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 260)) for _ in range(60)]
    shared = prose(rng, 90)
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 30)}" for _ in range(8)]
    texts += [texts[3], texts[3], texts[61] + " extra", "", "   \n", None, None, prose(rng, 9000), "word " * 300, "#$% " * 80, shared]
    rows = [(i, t, rng.choice(("en", None)), rng.choice(("src0", "src1", None)), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[7], "en", "src0", 3)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
