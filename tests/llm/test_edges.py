"""Odd rows through the operators that answer row by row."""

import public_tokenizers

from sparkloom.llm import language_id, quality_classifier, sentencepieces


def test_language_of_odd_rows(make_docs, odd_texts):
    docs = make_docs([*odd_texts, (7, "one more text of row seven")])
    rows = language_id.predict(docs, language_id.train(docs)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in [*odd_texts, (7, "")])
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.predict(make_docs([]), language_id.train(docs)).count() == 0


def test_pieces_of_odd_rows(make_docs, odd_texts):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepieces.encode(make_docs(odd_texts), model).collect()
    assert len(rows) == len(odd_texts)
    assert {len(r.ids) for r in rows if r.doc_id in (0, 1)} == {8}  # begin and end alone
    assert len({bytes(r.ids) for r in rows if r.doc_id in (6, 7)}) == 1
    assert sentencepieces.encode(make_docs([]), model).count() == 0


def test_quality_of_odd_rows(make_docs, odd_texts, spark):
    docs = make_docs(odd_texts)
    labels = spark.createDataFrame([(6, 1), (3, 0), (1, 0)], "doc_id long, quality int")
    network = quality_classifier.train(docs, labels)
    rows = quality_classifier.score(docs, network, score_col="_s").collect()
    assert len(rows) == len(odd_texts) and all(0 <= r._s <= 1 for r in rows)
    assert quality_classifier.score(make_docs([]), network, score_col="_s").count() == 0
