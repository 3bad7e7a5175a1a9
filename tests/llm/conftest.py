"""Odd documents that every operator must take."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 13) for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The cat sat on the mat and looked at the other cat.", "en", "a", 1),
    (2, "the CAT sat on the mat and looked at the other cat.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "en", "b", 0),
    (6, "12 34 !!", "en", "b", 0),
    (7, LONG, "en", "a", 1),
    (8, LONG.upper(), "en", "a", 1),
    (9, LONG.replace("theta3", "omega3", 1), None, "a", 1),
    (10, "É été là   ça «où» 漢字 <|endoftext|>x it's", "fr", "a", 1),
    (10, "É été là   ça «où» 漢字 <|endoftext|>x it's", "fr", "a", 1),
    (None, "nobody", "en", "a", 1),
    (None, None, None, None, None),
    (11, "é été", "fr", None, 1),
    (12, "9" * 5000 + " a@b", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """Extra columns that are called like results and helpers."""
    from pyspark.sql import functions as F

    names = ["keep_id", "group_size", "kept", "component_id", "root", "node", "ids", "decoded", "lang_pred", "score",
             "piece", "start", "length", "sequence_id", "offset", "fingerprint", "n", "word", "key", "kind", "end"]
    return odd_docs.withColumns({n: F.lit("clash") for n in names})
