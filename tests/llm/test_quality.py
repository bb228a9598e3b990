"""Quality rules, the quality classifier and language identification."""

import re
from collections import Counter

import numpy as np
import pytest
from texts import prose

from sparkloom.llm import language_id, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check_counts(rows, texts):
    for r in rows:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept in (True, False) and not (r.kept and r.base_failed)


def test_counts_of_odd_texts(make_docs, odd_texts):
    more = [(20, "a b c a b c"), (21, "a a a a"), (22, "x\nx\n \n\ny\nx"), (23, "a b c d a b c d b c d"), (24, "é\xa0b #|<>$ %&*")]
    rows = quality_rules.judge(make_docs(odd_texts + more)).collect()
    assert len(rows) == len(odd_texts) + len(more)
    check_counts(rows, dict(odd_texts + more))


def test_rules_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_quality_rules(spark, SF).collect()
    check_counts(rows, docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95


def test_kept_documents_have_their_own_columns(make_docs, odd_texts):
    docs = make_docs([*odd_texts, (30, prose(3, 20)), (31, prose(4, 20)), (32, "&& ## " * 200)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and 32 not in good
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_vote_model_finds_the_better_rules():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.8
    votes = []
    for accuracy, speaks in ((0.95, 0.9), (0.9, 0.8), (0.7, 0.9)):
        right, loud = r.random(len(truth)) < accuracy, r.random(len(truth)) < speaks
        votes.append(np.where(loud, np.where(right == truth, 1, -1), 0))
    patterns = sorted(Counter(map(tuple, np.array(votes).T.tolist())).items())
    model = quality_rules.VoteModel.fit(["a", "b", "c"], patterns)
    found = model.accuracies()
    assert found["a"] > found["b"] > found["c"]
    assert abs(found["a"] - 0.95) < 0.04 and abs(model.good - 0.8) < 0.06


def test_vote_model_of_nothing():
    assert 0 < quality_rules.VoteModel.fit(["a"], []).good < 1


def test_chunks_cover_a_text():
    for n in (0, 1, 511, 512, 513, 960, 5000):
        data = bytes((i * 7) % 251 + 1 for i in range(n))
        parts = quality_classifier.chunked(data)
        whole = bytearray(len(parts) * quality_classifier.STEP + quality_classifier.CHUNK)
        for i, p in enumerate(parts):
            whole[i * quality_classifier.STEP : i * quality_classifier.STEP + quality_classifier.CHUNK] = p.tobytes()
        assert bytes(whole[:n]) == data


def test_network_gradient():
    r = np.random.default_rng(1)
    net = quality_classifier.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs, y = [r.integers(1, 256, (2, 512)).astype(np.uint8), r.integers(1, 256, (1, 512)).astype(np.uint8)], np.array([1.0, 0.0])

    def loss():
        pool = np.concatenate([net.pooled(d)[0] for d in docs])
        p = net.combine(pool, np.array([0, 2]))[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradient(docs, y)
    for name, at in (("filters", (5, 3)), ("dense", (10, 4)), ("bytes", (100, 2)), ("out", (3,)), ("bias", (7,))):
        h = 1e-3
        net.p[name][at] += h
        up = loss()
        net.p[name][at] -= 2 * h
        down = loss()
        net.p[name][at] += h
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=0.1, abs=2e-4)


def test_network_learns_and_scores_whole_texts(make_docs, spark):
    good = [quality_classifier.chunked(prose(i).encode()) for i in range(60)]
    bad = [quality_classifier.chunked(("&&& " + prose(i).replace(" ", "$$$ ")).encode()) for i in range(60)]
    net = quality_classifier.Network.fit(good + bad, [1] * 60 + [0] * 60, epochs=20)
    late = prose(1, 300) + prose(2, 10).replace(" ", "$$$ ")
    docs = make_docs([(0, None), (1, ""), (2, prose(99)), (3, prose(98).replace(" ", "$$$ ")), (4, late), (5, prose(5, 300))])
    rows = {r.doc_id: r.score for r in quality_classifier.score(docs, net).collect()}
    assert all(0 <= x <= 1 for x in rows.values()) and rows[0] == pytest.approx(rows[1])
    assert rows[2] > 0.8 > 0.3 > rows[3] and rows[4] < rows[5]  # the end of a long text counts
    with pytest.raises(ValueError):
        quality_classifier.score(docs, net, score_col="text")


def test_network_of_one_label():
    docs = [quality_classifier.chunked(b"abc")]
    assert quality_classifier.Network.fit(docs, [1]).score([b"x"])[0] > 0.9
    assert quality_classifier.Network.fit([], []).score([b"x"])[0] == 0.5


def test_classifier_learns_from_whole_bounded_rows(make_docs, spark, monkeypatch):
    """Rows that share an id count once, a row beyond the bytes is passed over, and all of a long text is learned from."""
    seen = []
    monkeypatch.setattr(quality_classifier.Network, "fit", classmethod(lambda cls, docs, labels: seen.append((docs, labels)) or cls()))
    long_text = prose(1, 400)
    docs = make_docs([(1, long_text), (2, "b"), (2, "a"), (3, None), (4, "x" * 500_000), (5, "unlabelled"), (None, "y")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (6, 1), (None, 1), (5, None)], "doc_id long, quality int")
    quality_classifier.train(docs, labels, max_bytes=100_000)
    (parts, found), = seen
    texts = [b"".join(p[:quality_classifier.STEP].tobytes() for p in x).rstrip(b"\0") for x in parts]
    assert sorted(zip(map(len, parts), found, strict=True)) == sorted([(len(quality_classifier.chunked(long_text.encode())), 1), (1, 0), (1, 0)])
    assert {t[:20] for t in texts} == {long_text.encode()[:20], b"a", b""}
    quality_classifier.train(docs, labels, max_docs=1)
    assert len(seen[1][1]) <= 1


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality_classifier(spark, sf).filter("held_out").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = [r.score for r in rows if labels.get(r.doc_id) == 1], [r.score for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean([x > y for x in good for y in bad]) > 0.9
    assert np.mean([r.predicted for r in rows if labels.get(r.doc_id) == 1]) > 0.97


def test_language_scores_dont_depend_on_the_batch():
    rows = [("der die das und nicht " * 5, "de"), ("the of and to in is " * 5, "en"), ("le la les et des un " * 5, "fr")] * 20
    model = language_id.fit([language_id.ngram_counts(t) for t, _ in rows], [x for _, x in rows])
    texts = ["und nicht das", "the and of", "", None, "12 !", "les des", "a", "é", "²½①", "\u0300_٣", "½ʰ"]
    names, scores = model.predict(texts)
    assert names[:6] == ["de", "en", "und", "und", "und", "fr"] and names[8:10] == ["und", "und"] and names[10] != "und"  # numbers and marks aren't letters
    for t, n, s in zip(texts, names, scores, strict=True):
        one = model.predict([t])
        assert one[0][0] == n and one[1][0] == pytest.approx(s)
        assert 0 <= s <= 1
    places, n = language_id.ngram_counts(texts[0])
    x = n / n.sum()
    assert model.odds([texts[0]])[0] == pytest.approx(model.bias + x @ model.table[places], rel=1e-4)


def test_language_without_training_rows(make_docs):
    model = language_id.train(make_docs([]))
    assert [tuple(r) for r in language_id.predict(make_docs([(1, "abc")]), model).collect()] == [(1, "und", 0.0)]


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, sf).filter("held_out").collect()
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows]) > 0.97
