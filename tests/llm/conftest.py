import pytest
from pyspark.sql import types as T
from texts import prose

#: A clashing name, a null and an odd type among the extra columns.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("row", T.StringType()), T.StructField("score_", T.DoubleType()), T.StructField("n", T.ArrayType(T.IntegerType()))])

@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "x", 1.0, [1]) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one word, other scripts, surrogate-free symbols, a very long text and repeated rows."""
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "中文 текст 😀 é"), (5, "word " * 30_000), (6, prose(1)), (7, prose(1)), (7, prose(1)), (None, prose(2))]
