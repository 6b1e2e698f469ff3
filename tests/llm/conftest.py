import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, c string, rid string, rep string, rank string, shard string, h string, row string, n string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
    same = "the same text that stands in several rows of this table and is long enough to hold more than one window of two hundred bytes, " * 4
    texts = [(1, "plain text of a few words only"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, same), (7, same), (7, same), (None, same), (8, "123 !!! ###"), (9, "x" * 5000), (10, "née Ünïcode 漢字 テスト слово")]
    rows = [(i, t, "en" if i != 9 else None, "s" if i != 3 else None, None if t is None else len(t), *["z"] * 9) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
