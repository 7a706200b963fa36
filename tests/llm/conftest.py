import pytest

LONG = " ".join(f"wort{i % 977} idée{i * 7 % 1013}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, block string, h string, node string, slot string, w string, id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    plain = "The quick brown fox jumps over the lazy dog while seven wizards vex quietly beneath two pale moons."
    texts = [
        (1, plain),
        (2, None),
        (3, ""),
        (1, plain),
        (4, LONG),
        (None, "no id here but some words all the same"),
        (5, plain),
        (6, " \n\t  \n"),
        (7, "one two three"),
        (8, "Ünï cödé é’s <|endoftext|> x  y\r\n\n z\x1cq ½ a² 日本語 テスト。 don't I'll 12,5"),
        (9, "ONE two THREE"),
        (None, None),
        (4, LONG + " more")
    ]
    return [(i, t, None if k % 3 else "en", None, k, "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
