"""As-of and interval joins, overrides, fingerprints, cache keys, percentiles, dense search and two hops against plain Python."""

import hashlib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.operators import graph as G
from sparkloom.operators import reports as R
from sparkloom.operators import retrieval


@pytest.mark.parametrize("width", [None, 1, 7])
def test_as_of(spark, width):
    rng = random.Random(5)
    key, at = (lambda: rng.choice(["a", "a", "b", None])), (lambda: rng.choice([None, *range(40)]))
    left = [(i, key(), at()) for i in range(120)]
    right = [(key(), at(), rng.choice([None, 1, 2, 3]), rng.choice([0.5, 1.5])) for _ in range(80)]
    columns = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int, w double")
    block = None if width is None else F.floor(F.col("t") / width)
    found = {r.id: (r.v_as_of, r.w_as_of) for r in R.as_of(*columns, "k", "t", ["v", "w"], block).collect()}

    def last(k, t):
        known = [(u, v is not None, v or 0, w, v) for j, u, v, w in right if k is not None and t is not None and j == k and u is not None and u <= t]
        return (max(known)[4], max(known)[3]) if known else (None, None)

    assert found == {i: last(k, t) for i, k, t in left}
    assert R.as_of(columns[0], columns[1].limit(0), "k", "t", ["v"]).filter("v_as_of is not null").count() == 0


def test_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([None, rng.uniform(-50, 1200), float(rng.randint(0, 20))])) for i in range(200)]
    spans = [(100 + i, a, a + rng.choice([0.0, 0.01, 1.0, 2.5, 64.0, 1000.0, 1e9, -3.0])) for i, a in enumerate(rng.choice([0.0, 2.0, -40.0, 333.3]) for _ in range(40))]
    spans += [(200, None, 3.0), (201, 1.0, None)]
    met = R.in_interval(spark.createDataFrame(points, "p int, x double"), "x", spark.createDataFrame(spans, "s int, low double, high double"), "low", "high", 2.5)
    want = sorted((p, s) for p, x in points for s, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert sorted((r.p, r.s) for r in met.collect()) == want and len(want) > 500


def test_overridden(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "c", None)], "id int, k string, v string")
    other = spark.createDataFrame([("a", "n"), ("a", "m"), ("b", None), (None, "null"), ("c", "q"), ("c", None)], "k string, v string")
    assert sorted(map(tuple, R.overridden(rows, other, "k", ["v"]).collect())) == [(1, "a", "n"), (2, "b", "y"), (3, None, "z"), (4, "c", "q")]


def test_fingerprints_tell_rows_apart(spark):
    groups = {"a": [("x|", "y")], "b": [("x", "|y")], "c": [(None, "")], "d": [("", None)], "e": [("", "")], "f": [("x", "y"), ("x", "y")], "g": [("x", "y")], "h": [("1", "2"), ("3", "4")], "i": [("3", "4"), ("1", "2")], "j": [("1", "4"), ("3", "2")]}
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows], "k string, p string, q string")
    found = {r.k: r.fingerprint for r in R.fingerprint(df, "k", ["p", "q"]).collect()}
    assert found["h"] == found["i"] and len(set(found.values())) == len(found) - 1
    row = hashlib.md5(b"1:1|1:2").hexdigest(), hashlib.md5(b"1:3|1:4").hexdigest()
    words = [str(sum(int(m[8 * i : 8 * i + 8], 16) for m in row)) for i in range(4)]
    assert found["h"] == hashlib.sha256("|".join(["2", *words]).encode()).hexdigest()


def test_cache_keys(spark):
    df = spark.createDataFrame([("a \"q\"\n", 5, True, None)], "s string, n int, b boolean, x string")
    key = df.select(R.cache_key({c: F.col(c) for c in ("s", "x", "b", "n")})).first()[0]
    assert key == hashlib.sha256(b'{"b": true, "n": 5, "s": "a \\"q\\"\\n", "x": null}').hexdigest()


def test_percentiles_of_many_values(spark):
    rng = random.Random(7)
    groups = {"spread": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.randint(0, 3)) for _ in range(2000)], "far": [*(rng.random() for _ in range(900)), 1e12], "one": [2.0] * 500, None: [1.0, 4.0], "few": [3.0, 1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(6)
    marks = {f"{kind}{q}": (kind, q) for kind in ("floor_n1", "floor_n", "floor_n_less", "exclusive") for q in (0.01, 0.5, 0.95, 0.99)} | {"median": ("median", 0.5)}
    for r in A.percentiles(df, ["k"], "v", marks).collect():
        x = sorted(groups[r.k])
        n = len(x)
        for name, (kind, q) in marks.items():
            if kind == "exclusive":
                p = q * (n + 1)
                low = max(1, min(n - 1, math.floor(p)))
                want = max(x) if n < 20 else x[low - 1] + (p - low) * (x[low] - x[low - 1])
            else:
                want = {"floor_n1": x[math.floor(q * (n - 1))], "floor_n": x[min(math.floor(q * n), n - 1)], "floor_n_less": x[max(0, math.floor(q * n) - 1)], "median": statistics.median(x)}[kind]
            assert r[name] == pytest.approx(want, rel=1e-12), (r.k, name)
    whole = A.percentiles(df, [], "v", {"m": ("median", 0.5)}).collect()
    assert [r.m for r in whole] == [statistics.median(v for vs in groups.values() for v in vs)]


def test_dense_search_through_a_grid(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(200)] + [(200, None), (201, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = df.filter("vec_id < 30")
    sent = sorted(map(tuple, retrieval.dense(df, asked, 7, block=16).collect()))
    monkeypatch.setattr(retrieval, "SENT_BYTES", 0)
    assert sorted(map(tuple, retrieval.dense(df, asked, 7, block=16).collect())) == sent and len(sent) == 210
    x = np.array([v for _, v in rows[:200]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert {(q, d) for q, d, _, _ in sent} == {(q, int(d)) for q in range(30) for d in np.lexsort((np.arange(200), -np.round(x[q] @ x.T, 6)))[:7]}


def test_two_hops_past_hubs(spark):
    rng = random.Random(9)
    edges = {(rng.choice("abcd") if rng.random() < 0.5 else f"n{rng.randint(0, 30)}", rng.choice("RST"), rng.choice("abcd") if rng.random() < 0.5 else f"n{rng.randint(0, 30)}") for _ in range(400)}
    df = spark.createDataFrame([(*e, ["s"]) for e in edges], "head string, relation string, tail string, sources array<string>")
    both = [(e, e[0], e[1], e[2]) for e in edges] + [(e, e[2], e[1], e[0]) for e in edges if e[0] != e[2]]
    seeds = ["a", "n1", "n7", "nowhere"]
    want = set()
    for s in seeds:
        paths = {(m, t, r1, r2) for (e1, x, r1, m), (e2, y, r2, t) in itertools.product(both, both) if x == s and y == m and e1 != e2 and t != s}
        want |= {(s, r1, m, r2, t, k + 1) for k, (m, t, r1, r2) in enumerate(sorted(paths)[:10])}
    found = G.two_hops(df, spark.createDataFrame([(s,) for s in seeds], "entity string")).select("source", "rel1", "middle", "rel2", "target", "place")
    assert set(map(tuple, found.collect())) == want


def test_uploads(spark, tmp_path):
    from sparkloom.sources import intake as I

    png, pdf = b"\x89PNG\r\n\x1a\n rest", b"%PDF-1.4"
    files = [
        ("a.md", b"text"), ("../../etc/b.md", b"text b"), ("c.png", png), ("d.png", b"GIF89a"), ("e.PDF", pdf), (".hidden.md", b"x"), ("_x.md", b"x"), ("noend", b"x"), ("f.txt", b""), ("g.txt", None),
        ("h.txt", b"x" * 50), ("i..md", b"text"), ("", b"x"), (None, b"x"), ("j.webp", b"RIFF1234WEBP"), ("k.md/", b"known"), ("l.jpeg", b"\xff\xd8\xff"), ("ocr\\m.md", b"failed once"),
    ]
    rows = spark.createDataFrame([("me", i, n, c) for i, (n, c) in enumerate(files)] + [("you", 0, "k.md", b"known")], "owner string, place int, filename string, content binary")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    registry = spark.createDataFrame([("me", digest(b"known"), 7, "ready"), ("me", digest(b"known"), 5, None), ("me", digest(b"failed once"), 9, "failed"), (None, digest(b"text"), 1, "ready")], "owner string, sha256 string, document_id int, status string")
    found = {(r.owner, r.place): (r.name, r.verdict, r.document_id, r.agent_class) for r in I.judged(rows, registry, max_file_bytes=40).collect()}
    names = {0: "a.md", 1: "b.md", 2: "c.png", 3: "d.png", 4: "e.PDF", 7: "noend", 8: "f.txt", 9: "g.txt", 10: "h.txt", 11: "imd", 14: "j.webp", 15: "k.md", 16: "l.jpeg", 17: "ocrm.md"}
    verdicts = {3: "forged", 5: "hidden", 6: "hidden", 7: "unsupported", 8: "empty", 9: "empty", 10: "too_large", 11: "unsupported", 12: "hidden", 13: "hidden", 15: "duplicate"}
    for i in range(len(files)):
        assert found["me", i][:3] == (names.get(i), verdicts.get(i, "accepted"), 5 if i == 15 else None), i
    assert found["you", 0][1] == "accepted" and found["me", 2][3] == "pdf_text" and found["me", 0][3] == "general"
    much = {r.place: r.verdict for r in I.judged(rows, registry, max_total_bytes=10).collect() if r.owner == "me"}
    assert much[0] == much[1] == "accepted" and much[2] == "too_much" and much[5] == "hidden"
    (tmp_path / "up").mkdir()
    (tmp_path / "up/z.md").write_bytes(b"from a folder")
    out = I.judged(I.uploaded(spark, str(tmp_path / "up"), "me"), registry).collect()
    assert [(r.name, r.verdict, r.sha256) for r in out] == [("z.md", "accepted", digest(b"from a folder"))]
