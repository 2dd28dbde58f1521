import pytest

SCHEMA = "doc_id long, text string, score double, count long, fp string"


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = "The quick brown fox jumps over the lazy dog. " * 4000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (6, long), (7, long), (8, "Released under the MIT License."), (8, "Released under the MIT License."), (9, "Größe ü 日本 😀 end"), (None, "no id here at all, but words"), (10, "To " * 60), (11, "a  b   c")]
    return spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
