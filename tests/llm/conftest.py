import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, copies and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(6000))
    base = "the quick brown fox jumps over the lazy dog while seven wise men watch from the old stone bridge near town"
    rows = [(0, base, "en", "a"), (1, base, "en", "b"), (1, base, "en", "b"), (2, base + " today", "en", None), (3, None, "en", "a"), (4, "", None, "a"), (5, long, "en", "a"),
            (6, "one two", "en", "b"), (7, "ONE  two\n", "en", "b"), (8, "123 456 !!", None, "c"), (9, "Éa ñandú straße don't <|endoftext|> 漢字 😀", None, "c"), (None, "no id here", "en", "c"),
            (10, long + " end", "de", "a"), (11, " \t\n", "de", None), (12, "x" * 5000, "de", "a")]
    rows = [(*r, 7, "clash", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, node string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
