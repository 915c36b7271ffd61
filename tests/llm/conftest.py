import pytest

SF_DIR = "/root/testdata/sf0.01"
LONG = ("alpha beta, gamma\n" * 4000) + "x" * 5000
#: Nulls in every column, empty and white texts, ties, repeated rows, a very long text.
AWKWARD = [
    (0, "the same text here now", "en", "a"),
    (1, "the same  text\there now", "en", "b"),
    (2, "thesametextherenow", None, None),
    (2, "thesametextherenow", None, None),
    (3, None, "en", "a"),
    (4, "", "fr", "a"),
    (5, " \n\t ", "fr", None),
    (None, "no id, but a text of its own", "de", "b"),
    (None, None, None, None),
    (6, LONG, "en", "c"),
    (7, LONG + " ", "en", "c"),
    (8, "1234 5678 !!", "en", "c"),
    (-9, "ein zwei drei vier fünf é 中文 <|endoftext|> 🙂 ", "de", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents with more columns, some named like results."""
    rows = [(*row, 1.5, "x", True, None) for row in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score double, ids string, kept boolean, n_chars long"
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")
