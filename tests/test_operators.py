"""Edge rules on small frames: empty tables, ties, nulls, other scripts, scopes, and state machines on batches and streams."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import analytics as A
from sparkloom.operators import chunks as C
from sparkloom.operators import evaluation as E
from sparkloom.operators import graph as G
from sparkloom.operators import retrieval as R
from sparkloom.sources import files
from sparkloom.streaming import limits as L


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("", "zh"), (None, "zh"), ("...", "zh"), ("中ab12", "en"), ("中abc", "zh"), ("中文 abc", "zh"), ("hello", "en")])
def test_language(spark, text, want):
    assert one(spark, T.language("t"), text) == want  # a fifth exactly is not over the threshold


@pytest.mark.parametrize(("text", "want"), [("机器 AB-c 学", ["机", "器", "ab-c", "学"]), ("", []), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens("t"), text) == want


def test_numbers_and_dates(spark):
    assert one(spark, T.numbers("t"), "$5B, 25% of 1,000 and 3.5 million, 2K") == [5e9, 25.0, 1000.0, 3.5e6, 2000.0]
    assert one(spark, T.dates("t"), "2020年3月15日, 2020-03-15, Q1 2021, 3/15/20, 1999") == sorted({"1999", "2020", "2020-03-15", "2020年3月15日", "2021", "3/15/20", "Q1 2021"})


def test_redaction(spark):
    out, n = T.redacted("t")
    assert one(spark, out, "token: abcdef and sk-aaaaaaaaaaaaaaaaaaaa") == "[REDACTED] and [REDACTED]"
    assert one(spark, n, "nothing") == 0


def test_sentences(spark):
    assert one(spark, T.sentences("t"), "Dr. Who came. ok. 你好吗？好的呀")[-2:] == ["你好吗？", "好的呀"]
    assert one(spark, T.sentences("t"), "") == [] and one(spark, T.sentences("t"), "a.") == ["a."]


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(want)


def windows(text, size, overlap):
    size, overlap = C.sizes(size, overlap)
    if not text:
        return None
    out, i = [], 0
    while True:
        out.append(text[i : i + size])
        if i + size >= len(text):
            return out
        i += size - overlap


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 0), (4, 9), (1, 1), (0, -2)])
def test_windows(spark, size, overlap):
    texts = [None, "", "a", "abcd", "abcde", "中文abcdefg", "x" * 33]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.w for r in df.select("i", C.windows(F.col("t"), size, overlap).alias("w")).collect()}
    assert found == {i: windows(t, size, overlap) for i, t in enumerate(texts)}


def test_packed_sentences(spark):
    s = ["a" * 30, "b" * 40, "c" * 50, "d" * 10]
    got = spark.createDataFrame([(s,), ([],)], "s array<string>").select(C.packed_sentences(F.col("s"), 80, 5).alias("x")).collect()
    assert got[0].x == ["a" * 30 + "b" * 40, "bbbbb" + "c" * 50 + "d" * 10] and got[1].x == []


def test_scopes(spark):
    df = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(ValueError):
        R.scoped(df, None)
    assert R.scoped(df, []).count() == 0 and R.scoped(df, ["a"]).count() == 1 and R.scoped(df, None, required=False).count() == 2
    graph = spark.createDataFrame([("x", "R", "y", ["a"])], "head string, relation string, tail string, sources array<string>")
    with pytest.raises(ValueError):
        G.in_scope(graph, None)
    assert G.in_scope(graph, []).count() == 0 and G.in_scope(graph, ["a"]).count() == 1


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b"), (4, None), (5, "d"), (6, "e")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b"), (2, "zzz"), (3, ""), (4, "a")], "item_id long, text string")
    found = [(r.query, r.doc, r["rank"]) for r in R.bm25(docs, asked, 2).orderBy("query", "rank").collect()]
    assert [f for f in found if f[0] == 1] == [(1, 1, 1), (1, 3, 2)] and not [f for f in found if f[0] in (2, 3)]
    assert R.bm25(docs.limit(0), asked).count() == 0


def test_fusion_of_one_empty_channel(spark):
    a = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.4, 2)], "query long, doc long, score double, rank int")
    rows = R.fuse({"v": (a, 1.0), "b": (a.limit(0), 1.0)}).orderBy("doc").collect()
    assert [(r.doc, r.channels, r.b_score) for r in rows] == [(7, ["v"], None), (8, ["v"], None)]
    assert rows[0].hybrid_score == pytest.approx(1 / 61)


def test_relaxed_and_floor(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.1), (2, 1, 0.1), (2, 2, 0.01)], "query long, doc long, score double")
    assert {(r.query, r.doc) for r in R.relaxed(df).collect()} == {(1, 1), (2, 1)}
    assert {(r.query, r.doc) for r in R.with_floor(df, "score", 0.3, 1).collect()} == {(1, 1), (2, 1)}


def test_expand_parents(spark):
    rows = [(1, 10, "p", 0.5, "x"), (1, 11, "p", 0.9, "y"), (1, 12, None, 0.1, "z"), (1, 13, "gone", 0.2, "w")]
    df = spark.createDataFrame(rows, "query long, doc long, parent_id string, hybrid_score double, text string")
    parents = spark.createDataFrame([("p", "whole")], "parent_id string, text string")
    assert {(r.doc, r.text, r.granularity) for r in R.expand_parents(df, parents).collect()} == {(11, "whole", "parent"), (12, "z", "child"), (13, "w", "child")}


def test_metrics(spark):
    got = spark.createDataFrame([("s", 1, 5, 1), ("s", 1, 6, 2), ("s", 1, 7, 3), ("s", 2, 5, 1)], "system string, query long, doc long, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 9)], "query long, doc long")
    rows = {(r.query, r.k): r for r in E.per_query(got, rel, [1, 3, 10]).collect()}
    assert rows[1, 1].precision == 0 and rows[1, 3].precision == pytest.approx(1 / 3) and rows[1, 3].recall == 0.5 and rows[1, 3].rr == 0.5
    assert rows[1, 10].precision == pytest.approx(0.1) and rows[2, 3].f1 == 0 and rows[2, 3].ndcg == 0
    assert all(0 <= r[m] <= 1 for r in rows.values() for m in E.MEASURES)


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0), ("b", None)], "k string, v double")
    marks = {"n1": ("floor_n1", 0.95), "n": ("floor_n", 0.95), "less": ("floor_n_less", 0.95), "ex": ("exclusive", 0.95), "med": ("median", 0.5)}
    rows = {r.k: r for r in A.percentiles(df, ["k"], "v", marks).collect()}
    assert (rows["a"].n1, rows["a"].n, rows["a"].less, rows["a"].ex, rows["a"].med) == (9.0, 10.0, 9.0, 10.0, 5.5)
    assert {rows["b"][m] for m in marks} == {5.0}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "R", "b", ["s"]), ("b", "R", "c", ["s", "t"]), ("a", "R", "a", ["t"])], "head string, relation string, tail string, sources array<string>")
    seeds = spark.createDataFrame([("a",), ("zz",)], "entity string")
    assert {(r.entity, r.other) for r in G.neighbours(edges, seeds).collect()} == {("a", "a"), ("a", "b"), ("zz", None)}
    assert {(r.source, r.middle, r.target) for r in G.two_hops(edges, seeds).collect()} == {("a", "a", "b"), ("a", "b", "c")}
    assert {r["head"] + r["tail"] for r in G.without_source(edges, "s").collect()} == {"bc", "aa"}


def test_fuzzy(spark):
    names = spark.createDataFrame([("Kubernets",), ("abc",), ("zzzz",)], "name string")
    entities = spark.createDataFrame([("Kubernetes",), ("abd",), ("abe",)], "entity string")
    assert {(r.name, r.entity, r.distance) for r in G.fuzzy_matches(names, entities).collect()} == {("Kubernets", "Kubernetes", 1), ("abc", "abd", 1)}


def test_limiter_keeps_the_edge():
    m = L.SlidingWindow(2, 10)
    assert [m.step({"t": t})["allowed"] for t in (0, 5, 10, 10.5, 16)] == [True, True, False, True, True]


def test_breaker():
    m = L.Breaker(2, 10, 2)
    steps = [(0, False), (1, False), (2, True), (11, True), (12, True), (13, False), (14, False), (15, True), (30, False), (31, True)]
    assert [m.step({"t": t, "ok": ok})["state"] for t, ok in steps] == ["closed", "open", "open", "half_open", "closed", "closed", "open", "open", "open", "open"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), max_size=30))
def test_saved_state_goes_on(steps):
    steps = sorted(steps)
    for make in (lambda: L.SlidingWindow(2, 10), lambda: L.Breaker(2, 10, 2), lambda: L.Throttle(7)):
        whole, parts = make(), make()
        for t, ok in steps:
            fresh = make()
            fresh.load(json.loads(json.dumps(parts.save())))
            parts = fresh
            assert whole.step({"t": t, "ok": ok}) == parts.step({"t": t, "ok": ok})


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(f"k{i % 3}", float(t)) for i, t in enumerate([0, 1, 1, 2, 3, 3, 9, 9, 12, 30])]
    df = spark.createDataFrame(rows, "k string, t double")
    out = "allowed boolean, remaining int, reset_at double"
    batch = {tuple(r) for r in L.decided(df, "k", ["t"], lambda: L.SlidingWindow(1, 5), out).collect()}
    for i, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, "k string, t double").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema("k string, t double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.stateful(stream, "k", lambda: L.SlidingWindow(1, 5), out, idle_seconds=None).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        assert {tuple(r) for r in spark.sql("SELECT * FROM limited").collect()} == batch
    finally:
        q.stop()


def test_files(spark, tmp_path):
    folder = tmp_path / "docs/sub"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "docs/b.MD").write_bytes("中文".encode("gb18030"))
    (tmp_path / "docs/c.exe").write_bytes(b"x")
    assert {r.text for r in files.documents(spark, str(tmp_path / "docs")).collect()} == {"héllo", "中文"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert {r.a for r in rows.collect()} == {1, 2}
    assert [r.a for r in files.tail(rows, "a", 1).collect()] == [2] and files.tail(rows, "a", 0).count() == 2
    (tmp_path / "q.json").write_text('{"queries": [{"id": "1", "query": "x"}]}')
    (tmp_path / "bad.json").write_text('{"other": 1}')
    assert files.eval_queries(spark, str(tmp_path / "q.json")).count() == 1
    with pytest.raises(ValueError):
        files.eval_queries(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        files.export(rows, str(tmp_path / "o"), "xml")
    files.export(rows.select(F.array("a").alias("l")), str(tmp_path / "csv"), "csv")
    assert "[1]" in spark.read.option("header", "true").csv(str(tmp_path / "csv")).orderBy("l").first().l
    files.append_json(rows, str(tmp_path / "log"))
    files.append_json(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).filter("created_at is not null").count() == 4
    assert "# TYPE a counter\na 1\n" in files.prometheus([("a", "counter", 1.0)])


def test_compression_of_every_query(spark):
    """Each query with documents has rows, and its documents share one budget in the order of rank."""
    from sparkloom.functions import rules as U
    from sparkloom.plans import registry

    registry.load_all()
    rows = registry.QUERIES["rules_compressed"](spark, "/root/testdata/sf0.001").collect()
    asked = registry.QUERIES["retrieve_reranked"](spark, "/root/testdata/sf0.001").select("query").distinct().collect()
    assert {r.item_id for r in rows} == {r.query for r in asked} and len(asked) > 1
    docs = [(1, ["a" * 30]), (2, ["b" * 80]), (3, ["c" * 20]), (4, []), (5, ["d" * 50]), (6, ["e"])]
    df = spark.createDataFrame([(docs, ["x"])], "docs array<struct<doc:long,sentences:array<string>>>, terms array<string>")
    found = df.select(U.compressed_in_turn(F.col("docs"), F.col("terms"), budget=100).alias("k")).first().k
    assert [(k.doc, len(k.text)) for k in found] == [(1, 30), (3, 20), (5, 50)]


@pytest.mark.parametrize("search", [R.bm25, R.overlap_search])
def test_searches_score_documents_where_they_lie(spark, monkeypatch, search):
    """Before, every pair of query and document that share a word was shuffled. The joins that larger query sets take give the same rows."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1, 40) if (i * 7 + j * j) % (j % 9 + 2) == 0) + (" w3" * (i % 4)), "x") for i in range(300)] + [(300, None, "x"), (301, "", "x"), (302, "w1 w1 中文", "x")], "doc_id long, text string, term string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i} w{2 * i} zz") for i in range(1, 20)] + [(50, None), (51, "中 w1")], "item_id int, text string").repartition(3)
    rows = lambda found: sorted(map(tuple, found.select("query", "doc", F.round("score", 6), "rank").collect()))
    few = search(docs, asked, 4)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    ours = rows(few)
    monkeypatch.setattr(R, "TOGETHER", 3)
    monkeypatch.setattr(R, "ADDED", 10)
    assert rows(search(docs, asked, 4)) == ours
    monkeypatch.setattr(R, "SENT_TERMS", 0)
    assert rows(search(docs, asked, 4)) == ours and len(ours) > 70
    monkeypatch.undo()
    shared = docs.unionByName(docs.filter("doc_id < 5"))
    assert "Join" in search(shared, asked, 4)._jdf.queryExecution().optimizedPlan().toString()
