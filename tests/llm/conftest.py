import pytest

from lattiq.llm.common import Scratch
from lattiq.llm.queries import tokenizer_path


@pytest.fixture
def scratch(spark, request):
    return Scratch(spark, f"test-{request.node.name[:20].replace('[', '-').replace(']', '')}")


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_path("word_bpe_49k.json")


LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with operators' own."""
    rows = [
        (1, "a b c d e f g\nsecond line here", "en", "s1", 1, "x"),
        (1, "a b c d e f g\nsecond line here", "en", "s1", 1, "x"),
        (2, "", "en", "s1", 0, None),
        (3, None, None, None, None, None),
        (None, "text without an id", "de", "s2", 5, "y"),
        (None, None, None, None, None, None),
        (4, LONG, "en", "s1", 1, "z"),
        (5, LONG + " ", "en", "s1", 1, "z"),
        (6, "naïve café 😀   日本語 \x1f\x85 don't ' 12", "fr", "s2", 1, ""),
        (7, "   \n\t ", "fr", "s2", 1, ""),
        (8, "<|endoftext|> one <|endoftext|>", "fr", "s2", 1, ""),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").withColumnRenamed("node", "fp")
