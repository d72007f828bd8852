import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, gone int, cluster string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and white texts, ties, repeated rows, a very long text, clashing extra columns."""
    long = " ".join(f"word{i % 997} filler{i % 31}" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, None, None, None),
        (None, base + " more", "en", "b"),
        (None, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n \n", "en", "a"),
        (6, long, "en", "a"),
        (7, base.upper() + "\n" + base, "de", None),
        (8, "Σίσυφος É <|endoftext|> 'll  can't", "el", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", 1, "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
