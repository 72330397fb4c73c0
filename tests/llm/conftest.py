import public_tokenizers
import pytest

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer_path():
    return PATH


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeats, clashing extra columns."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one"
    rows = [
        (1, base, "en", "a", 1, 0), (2, None, None, None, None, None), (3, "", "en", "a", 0, 1), (4, base.upper(), "en", None, 1, 2), (5, base, "en", "b", 1, 3),
        (6, " \n\t ", "en", "b", 1, 4), (7, "x", None, "b", 1, 5), (8, "x", "fr", "c", 1, 6), (9, base + " " + base, "en", "a", 1, 7), (10, "é 日本 <|endoftext|> 🙂 it's  4539578763621486 a.b1@c.org", "en", "c", 1, 8),
        (11, "word%d " * 30000 % tuple(range(30000)), "en", "a", 1, 9), (12, "word%d " * 30000 % tuple([*range(29990), *range(10)]), "en", "a", 1, 9), (None, base + " end", "en", "a", 1, 9), (13, "y" * 200_000, "de", "d", 1, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
