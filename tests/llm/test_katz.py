"""The language model against a plain version in dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import prose

from sparkloom.llm import katz, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, learned):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    one, two = Counter(), Counter()
    for w, is_train in zip(tokens, learned, strict=True):
        if is_train:
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
    total = sum(one.values())
    unigrams = katz.Unigrams(Counter(one.values()), total, len(one))
    discount = katz.Discounts(Counter(two.values()))
    p = lambda w: float(unigrams(np.array([one[w]]))[0])
    kept, mass = Counter(), Counter()
    for (v, w), c in two.items():
        kept[v] += float(discount(np.array([c]))[0]) * c
        mass[v] += p(w)
    count = lambda v: sum(learned) if v == "<s>" else one[v]

    def chance(v, w):
        n = count(v)
        d = n + 1 if kept[v] > n * (1 - 1e-12) else n
        if two[v, w]:
            return float(discount(np.array([two[v, w]]))[0]) * two[v, w] / d
        return p(w) * ((1 - kept[v] / d) / (1 - mass[v]) if n else 1)

    out = []
    for (i, _), w in zip(rows, tokens, strict=True):
        base = sum(math.log10((one[x] + 0.1) / (total + 0.1 * (len(one) + 1))) for x in w)
        out.append((i, len(w), sum(one[x] > 0 for x in w), total, base, sum(math.log10(chance(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))))
    return out, one, chance


def compare(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:4]) == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_scores(make_docs, odd_texts):
    rows = [*odd_texts, *((100 + i, prose(i % 30, 6)) for i in range(60)), (300, "THE unseen-word of")]
    learned = [i is not None and i % 10 != 0 for i, _ in rows]
    found = katz.score(make_docs(rows), F.col("doc_id") % 10 != 0)
    want, one, chance = brute(rows, learned)
    compare([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()], want)
    # all words and the unseen one together have probability 1 in any context
    for v in ["<s>", "the", "word", "w1", "never"]:
        assert sum(chance(v, w) for w in [*one, "never"]) == pytest.approx(1, abs=1e-9)


def test_without_training_rows(make_docs):
    rows = katz.score(make_docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(r.base_score == pytest.approx(0) and math.isfinite(r.score) for r in rows)
    assert katz.score(make_docs([]), F.lit(True)).count() == 0


def test_small_blocks_give_the_same(make_docs, monkeypatch):
    rows = [(i, prose(i % 7, 5)) for i in range(40)]
    coded = katz.coded
    monkeypatch.setattr(katz, "coded", lambda *a: coded(*a, characters=500))
    found = katz.score(make_docs(rows), F.col("doc_id") % 10 != 0)
    compare([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()], brute(rows, [i % 10 != 0 for i, _ in rows])[0])


def test_discounts_lie_between_0_and_1():
    for of in ({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 5, 2: 9, 3: 1}, {1: 3}, {2: 5}, {}, {1: 10, 6: 50}):
        d = katz.Discounts(of).d[1:]
        assert ((d > 0) & (d <= 1)).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    rows = queries.op10_katz(spark, sf).collect()
    compare([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows], brute(docs, [not held[i] for i, _ in docs])[0])
    assert {r.doc_id: r.held_out for r in rows} == held
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
