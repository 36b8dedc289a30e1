import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that break careless code: nulls everywhere, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "plain text of some words\nand a second line\n"), (2, None), (3, ""), (None, "no id"), (None, None), (4, long), (4, long), (5, " \t\n"), (6, "é 日本 🙂 <|endoftext|> <|im_end|> \x00 'll"), (7, "plain text of some words\nand a second line\n"), (7, "another row of the same id")]
    extra = [(i, t, 1, 2, "x", "y", 0.5, "z") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n_tokens int, n_words int, id string, row string, score double, kept string")


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]
