"""Values that a plan computes once, and batches that are worked on in parts."""

import pyarrow as pa

from sparkloom.operators import dictionary as D
from sparkloom.operators import keywords as K
from sparkloom.operators import linetypes as N
from sparkloom.operators import references as R


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def texts(spark):
    return spark.createDataFrame([(i, f"Alpha beta gamma delta{i} beta Alpha epsilon gamma. " * (i % 5)) for i in range(40)], "doc_id long, text string")


def test_texts_are_ranked_some_at_a_time(spark, monkeypatch):
    whole = K.text_rank(texts(spark)).collect()
    monkeypatch.setattr(K, "RANKED_WORDS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([["a"] * 12, ["b"] * 9, None, ["c"] * 11])], names=["doc", "w"])
    parts = list(K._parts(batch))
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert sorted(map(tuple, K.text_rank(texts(spark)).collect())) == sorted(map(tuple, whole))


def test_entities_of_a_sentence_are_looked_for_once(spark):
    assert analysed(texts(spark).select(R.with_context("text").alias("x"))).count("regexp_extract_all(") == len(R.ENTITIES)


def test_only_asked_terms_have_synonyms_listed(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "z")], "query long, at int, word string")
    found = D.with_synonyms(rows, spark.createDataFrame([("a", "b"), ("q", "r")], "term string, synonym string"))
    assert "LeftSemi" in analysed(found) and found.first().expression == "(a OR b) z"


def test_a_line_is_trimmed_once(spark):
    df = texts(spark)
    assert analysed(df.select(N.kind(df.text).alias("x"))).count("regexp_replace(") == 4
