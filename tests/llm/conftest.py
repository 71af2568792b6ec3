import pytest

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog. " * 8,
    "The quick brown fox jumps over the lazy dog. " * 8,
    "Écrit à zoë@example.org, or +1 (487) 555-7209; card 4111 1111 1111 1111, host 10.0.0.300 and 8.8.8.8.",
    'Line one is here, with words.\n| a | b | c |\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"\nAll rights reserved.',
    "x" * 3000 + " 12345 ### !!! don't  stop　now end",
    "word " * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of the operators."""
    rows = [(k if k != 3 else None, t, "s1" if k % 3 else None, f"slot{k}", k) for k, t in enumerate(TEXTS)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, size long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
