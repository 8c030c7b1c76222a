import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, print int, start string"

TEXTS = [
    None, "", " ", "\n\t  \r\n", "a", "Hello, world.", "Hello, world.", "the " * 3000, "x" * 20000, "0123456789" * 300, "naïve café Straße ﬁ Ⅳ 日本語 😀 é",
    "▁odd▁ marks <s> </s> <0x0A> <|endoftext|>", "mail me at a.b@c-d.example.com, call +44 20 7946 0958 or 10.0.0.255", "1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (123) 555-0101",
    "tab\tseparated\tvalues\r\nand  double  spaces   here",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeats, an id that occurs twice, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", None, "de"][i % 3], "s", None if t is None else len(t), "clash", 1, "x") for i, t in enumerate(TEXTS)]
    rows += [(5, "Hello, world.", "en", None, 13, None, None, None), (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
