import os
import random

import pytest

pytest.importorskip("musterroll.llm")

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, component_id int, kept string, nth int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeats, and names that operators use."""
    rng = random.Random(5)
    words = ["the", "of", "Überall", "été", "niño", "x1", "and", "..."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, "the cat and the dog went out\nthe cat and the dog went out", "en"), (2, "", "en"), (3, None, "fr"),
        (None, "une phrase pour le chat et le chien de la maison", "fr"), (None, None, None), (4, long, None),
        (5, "the cat and the dog went out", "en"), (5, "the cat and the dog went out", "en"), (6, " \n\t \n", "en"),
        (7, "call +1 (514) 555-8389 or a.b@mail.example.com", "en"), (8, "12345 !!! 678", None),
        (9, "\n".join(["a line of ten words that will come back again here"] * 3), "en"),
    ]
    return spark.createDataFrame([(*r, "s", 1, "clash", 7, None, 3) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (20, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, None), (3, [nan, 1.0, 0.0]), (4, [inf, 1.0, 0.0]),
        (5, [None, 1.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [2.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.5]), (40, []), (60, [1.0, 2.0]),
        (61, [1.0, 2.0]), (8, [-0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (80, [0.0, 0.9, 0.1]),
    ]
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "vec_id bigint, embedding array<float>, n_links int, v string, size int")
