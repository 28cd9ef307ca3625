import pytest

LONG = "word of the long text " * 4000
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog that was there.", "en", "a"),
    (2, "the CAT sat on the mat and looked at the dog that was there.", "en", "a"),
    (3, "Der Hund und die Katze sind im Haus und schlafen dort.", "de", "b"),
    (4, None, "en", "b"),
    (5, "", None, "c"),
    (6, " \t\n", "en", None),
    (7, "12345 +++ 678", "en", "c"),
    (8, LONG, "en", "a"),
    (9, "Ünï   é\U0001f600 x\x1fy", "fr", "c"),
    (10, "mail a.b@c.example and +1 (743) 555-3824 or 4111 1111 1111 1111 at 10.0.0.255 x", "en", "a"),
    (11, "The cat sat on the mat and looked at the dog that was there.", "en", "z"),
    (11, "The cat sat on the mat and looked at the dog that was there.", "en", "z"),
    (None, "nobody knows my id but the text is here all the same", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    rows = [(i, t, lang, source, len(t or ""), "x", 1.5, 7) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard double, block int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
