"""Importance resampling against plain Python, on the whole small table and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from sparkloom.llm import importance
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=10_000, longest=2):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(x.encode()) % buckets for x in runs)


def brute(docs, target, percent=25, buckets=10_000, longest=2, seed=7, least=20):
    rows = [(i, *features(t, buckets, longest)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(features(x, buckets, longest)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for k, (i, words, f) in enumerate(rows):
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), k))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: j + 1 for j, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((i, w, n, weight, score, rank.get(k)) for i, w, n, weight, score, k in out), key=str)


def test_query_on_the_whole_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    target = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    found = QUERIES["op13_importance_resampling"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r[:1] + r[2:] for r in brute(docs, target)), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(2, 10_000, 25), (1, 7, 100), (3, 50, 60)])
def test_odd_rows(spark, make_docs, odd_texts, longest, buckets, percent):
    words = "Alpha beta GAMMA delta 10 20 ÄÖ x-y 中文 end. "
    docs = [*odd_texts, *((100 + i, words * (1 + i % 5)) for i in range(40)), *((200, words * 3) for _ in range(20)), (None, words * 3), (None, words * 3)]
    target = [None, "", words, "one two three four"]
    found = importance.resample(make_docs(docs).repartition(6), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent=percent, buckets=buckets, longest=longest)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, target, percent, buckets, longest)


def test_empty_tables(spark, make_docs, odd_texts):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(make_docs([]), empty).count() == 0
    assert sorted(map(tuple, importance.resample(make_docs(odd_texts), empty).collect()), key=str) == brute(odd_texts, [])


@pytest.mark.parametrize("at_once", [1, 5, 40])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_parts_of_a_long_text_give_its_features(monkeypatch, at_once, longest):
    monkeypatch.setattr(importance, "_AT_ONCE", at_once)
    for text in ("A b-c, d e é 10x F", "word " * 30, "", "onlyone", " lead and trail "):
        n, at, counts = importance.counted(text.encode(), 101, longest)
        assert (n, dict(zip(at.tolist(), counts.tolist(), strict=True))) == (lambda w, f: (w, dict(f)))(*features(text, 101, longest))


def test_equal_scores_span_ranges(spark):
    """One id in 3,000 rows, so one score: the ranks are whole, though the ranges cut within it."""
    rows = spark.range(3000).selectExpr("id AS row", "cast(7 AS long) AS doc_id", "cast(20 AS long) AS n_words", "cast(1 AS long) AS n_features", "cast(5 AS long) AS weight", "cast(5 AS long) AS score").repartition(8)
    found = importance.drawn(rows, 50, 20).collect()
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 1501)) and len(found) == 3000


def test_a_row_of_the_matrix_is_a_document(spark):
    """Spark reads 4096 rows of a file at once, whatever they hold: a row is one document with an entry for each bucket at most."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' x', 7 * id, ' '), 40) AS text").coalesce(1)
    long = spark.range(1).selectExpr("9999 AS doc_id", "array_join(transform(sequence(1, 300000), i -> concat('w', i)), ' ') AS text")
    sparse = importance.matrix(docs.unionByName(long), buckets=5000)
    sizes = [sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) for r in sparse.collect()]
    assert len(sizes) == 3001 and sorted(sizes)[-2] <= 8 * 5 and max(sizes) <= 8 * 5000
