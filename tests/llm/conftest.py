import pytest
from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (id, text[, source]) rows."""

    def build(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCUMENT)

    return build


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, ties and repeated rows, clashing names."""
    from pyspark.sql import functions as F

    long = "word " * 30_000 + "end."
    df = documents((1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "same  text\there"), (None, None, None), (7, long), (8, "  \n \t "), (9, "pé \U0001f600 token = \"abcdef123456\""))
    return df.withColumns({"digest": F.lit("x"), "score": F.lit(1), "row": F.lit(2), "id": F.lit(3), "size": F.lit(4), "n": F.lit(5), "label": F.lit(0), "key": F.lit("k"), "fingerprint": F.lit(6), "stats": F.lit(7), "locator": F.lit("l"), "_row": F.lit(8), "_q": F.lit(9), "_stats": F.lit(10), "_id": F.lit(11), "_dropped": F.lit(12), "_copy": F.lit(13), "bit": F.lit(14)})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
