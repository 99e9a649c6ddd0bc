import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "The common boilerplate line of many documents."


def words(seed: int, n: int) -> str:
    """Invented words, different for each seed."""
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfghklmnprst"[(x >> s) % 14] + "aeiou"[(x >> s) % 5] for s in (3, 9, 15)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text."""
    base = words(1, 60)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, base, "en", None, 5), (4, base, "en", None, 5),
        (5, base, "en", "b", None), (None, base + " extra", None, "b", 1), (None, None, None, None, None), (6, "one two", "fr", "c", 7),
        (7, "one two", "fr", "c", 7), (8, words(2, 30_000), "en", "d", 1), (9, f"{LINE}\n{words(3, 40)}\n{LINE}", "en", "e", 2),
        (10, f"{words(4, 40)}\r\n  {LINE.upper()} ", "de", "e", 2), (11, "\U0001f600 é́ \u2003x 123 !!!", "de", "e", 2),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Columns that bear names which the operators use themselves."""
    names = ["key", "digest", "first", "cluster", "slot", "n", "kept", "n_lines", "component", "class", "keys", "id", "batch", "ids", "item_ids"]
    return odd_docs.selectExpr("*", *(f"'x' AS `{n}`" for n in names))


def rows(df):
    return [tuple(r) if isinstance(r, Row) else r for r in df.collect()]
