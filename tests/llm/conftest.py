import pytest

LONG = " ".join(f"word{i % 977} item{i % 1013}" for i in range(6000))
PASSAGE = " ".join(f"shared{i} passage{i * 7 % 31}" for i in range(40))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again\nA line that many documents have in common\nlast", "x"),
        (2, "the quick brown fox jumps over the lazy dog again and again\nA line that many documents have in common\nlast", "x"),
        (3, "  a LINE that many documents have in common \nother text of its own here", "y"),
        (4, None, None),
        (5, "", "z"),
        (6, LONG, "x"),
        (7, LONG.replace("word5 ", "changed "), "x"),
        (8, "a b", "x"),
        (9, "zzzz" * 200, "x"),
        (10, "Grüße,  Straße\r\n\t’quoted’ 12345 \U0001f600 é <|endoftext|>\n\n end ", "x"),
        (11, "first words " + PASSAGE + " tail one", "x"),
        (12, "other start here " + PASSAGE + " and another tail", "x"),
        (13, "x", None),
        (13, "x", None),
        (14, "a line that many documents have in common\na line that many documents have in common\nend", "x"),
        (15, "\n\n\n", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string").cache()


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
