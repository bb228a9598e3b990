"""Keywords, lines, layout, formulas, messages and deletion against plain Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import formulas as M
from sparkloom.functions import messages as J
from sparkloom.functions import text as T
from sparkloom.functions import vectorised as V
from sparkloom.operators import deletion as D
from sparkloom.operators import keywords as K
from sparkloom.operators import layout as L
from sparkloom.operators import linetypes as N
from sparkloom.plans import registry, structure
from sparkloom.streaming import limits

SF = "/root/testdata/sf0.001"
registry.load_all()
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def words(text):
    return [x for x in re.findall(r"[A-Za-z0-9_\-]+|[一-鿿]", (text or "").lower()) if len(x) >= 2 and x not in T.REWRITE_STOP_WORDS]


def text_rank(text, span=5, damping=0.85, rounds=10, most=10):
    ws, edges = words(text), Counter()
    for i, a in enumerate(ws):
        for b in ws[i + 1 : i + span]:
            if a != b:
                edges[a, b] += 1
                edges[b, a] += 1
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    score = dict.fromkeys(ws, 1.0)
    for _ in range(rounds):
        new = dict.fromkeys(score, 1 - damping)
        for (a, b), n in edges.items():
            new[b] += damping * n / out[a] * score[a]
        score = new
    top = max(score.values(), default=1)
    return sorted(((round(s / top, 9), w) for w, s in score.items()), key=lambda x: (-x[0], x[1]))[:most]


def test_text_rank_on_the_whole_small_table(spark):
    rows = registry.QUERIES["text_rank"](spark, SF).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc, r.place)):
        found.setdefault(r.doc, []).append((r.score, r.word))
    want = {i: text_rank(t) for i, t in documents().items() if words(t)}
    assert found.keys() == want.keys()
    for i, w in want.items():  # sums in another order may differ in the ninth place
        assert [s for s, _ in found[i]] == pytest.approx([s for s, _ in w], abs=3e-9)
        everything = dict((x, s) for s, x in text_rank(documents()[i], most=10**6))
        assert all(everything[x] == pytest.approx(s, abs=3e-9) for s, x in found[i]) and len({x for _, x in found[i]}) == len(w)


def test_text_rank_of_odd_texts(spark):
    texts = [None, "", "the of", "one", "one one one", "alpha beta alpha gamma beta alpha", "中文 测试 alpha"]
    df = spark.createDataFrame([(i % 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string").coalesce(1)
    rows = K.text_rank(df).collect()
    want = sorted((i % 3, p + 1, w, s) for i, t in enumerate(texts) for p, (s, w) in enumerate(text_rank(t)))
    assert sorted((r.doc, r.place, r.word, pytest.approx(r.score, abs=3e-9)) for r in rows) == want
    assert K.text_rank(df.limit(0)).count() == 0 and K.tf_idf(df.limit(0)).count() == 0


def tf_idf(texts: dict, most: int = 10) -> list:
    bags = {i: Counter(words(t)) for i, t in texts.items() if words(t)}
    df = Counter(w for b in bags.values() for w in b)
    scores = {i: sorted((-round(n / b.total() * math.log(len(bags) / df[w]), 9), w) for w, n in b.items()) for i, b in bags.items()}
    return sorted((str(i), p + 1, w, -s) for i, found in scores.items() for p, (s, w) in enumerate(found[:most]))


@pytest.mark.parametrize("known", [1, 40, 1 << 18])
def test_tf_idf_takes_only_words_that_may_be_among_the_best_out_of_a_text(spark, monkeypatch, known):
    taken = []
    find = K._candidates
    monkeypatch.setattr(K, "KNOWN_WORDS", known)
    monkeypatch.setattr(K, "_candidates", lambda *a: taken.append(find(*a)) or taken[-1])
    draw = random.Random(3)
    said = [" ".join(f"w{int(draw.paretovariate(0.5)) % 3000}" for _ in range(draw.choice([3, 30, 300]))) for _ in range(120)]
    rows = [*enumerate(said), (200, "The WORD w1 w2"), (200, "word w3 中文 a-b_c"), (200, None), (201, ""), (202, "the of"), (None, "w1 lone"), (None, "w2"), (203, said[0]), (203, said[0])]
    texts: dict = {}
    for i, t in rows:
        texts[i] = f"{texts.get(i, '')} {t or ''}"
    found = K.tf_idf(spark.createDataFrame(rows, "doc_id long, text string"), most=5).collect()
    want = tf_idf(texts, 5)
    assert sorted((str(r.doc), r.place, r.word, pytest.approx(r.score, abs=2e-9)) for r in found) == want
    pairs = sum(len(set(words(t))) for t in texts.values())
    assert taken[0].count() <= (pairs / 2 if known > 40 else pairs)


def test_prepared_texts(spark):
    df = spark.createDataFrame([(1, "中文　文本  测试"), (2, "plain english words"), (3, None), (4, "混合 text")], "doc_id long, text string")
    rows = {r.doc: r for r in K.prepared(df).collect()}
    assert (rows[1].language, rows[1].text, rows[1].token_count, rows[1].searchable) == ("chinese", "中文 文本 测试", 6, "中文 文本 测试\n中 文 文 本 测 试")
    assert rows[2].token_count is None and rows[2].keywords is None and rows[2].searchable == "plain english words"
    assert rows[3].text == "" and rows[3].language == "unknown"


def lines(text):
    blocks, i, ls = [], 0, (text or "").splitlines()

    def title(x):
        x = x.strip()
        return bool(x) and len(x) <= 100 and (any(re.match(p, x) for p in N.TITLES) or (len(x) < 50 and (x.isupper() or bool(re.match(N.SHORT_TITLE, x)))))

    item = lambda x: next((m for p in N.ITEMS if (m := re.match(p, x))), None)
    row = lambda x: any(re.search(p, x) for p in N.ROWS)
    code = lambda x: bool(x.strip()) and len(x) - len(x.lstrip()) >= 4 and any(c in x for c in "{}();=<>[]")

    def level(x):
        if x.startswith("#"):
            return min(6, x.count("#"))
        for p, n in (("^第[一二三四五六七八九十]章", 1), ("^第[一二三四五六七八九十]节", 2), (r"^\d+\.\s", 2), (r"^\d+\.\d+\.\s", 3)):
            if re.match(p, x):
                return n
        return 1 if len(x) < 30 else 2

    while i < len(ls):
        x = ls[i].rstrip()
        i += 1
        if not x.strip():
            continue
        if title(x):
            blocks.append(("title", level(x.strip()), x.strip()))
        elif item(x):
            bare = x.strip()
            blocks.append(("list_item", (len(x) - len(x.lstrip())) // 2, bare[m.end() :].strip() if (m := item(bare)) else bare))
        elif row(x):
            blocks.append(("table_row", 0, x.strip()))
        elif code(x):
            more = [x]
            while i < len(ls) and code(ls[i]):
                more.append(ls[i])
                i += 1
            blocks.append(("code", 0, "\n".join(more)))
        else:
            more = [x.strip()]
            while i < len(ls) and ls[i].strip() and not (title(ls[i].rstrip()) or item(ls[i].rstrip()) or row(ls[i].rstrip())):
                more.append(ls[i].strip())
                i += 1
            out = more[0]
            for a, b in zip(more, more[1:], strict=False):
                out += (" " if a[-1].isalnum() and not re.match("[一-鿿㐀-䶿]", a[-1]) else "") + b
            blocks.append(("paragraph", 0, out))
    return [(k, *b) for k, b in enumerate(blocks)]


LINES = [
    "TITLE HERE\nfirst line\nsecond line.\nthird\n\n  • item one\n    2. item (two) = x;\n\t\n| a | b |\na\tb\tc\n    x = f(1);\n    y = {2}\nplain\n    z = [3]\nend",
    "第一章 开始\n中文段落\n继续，\n结束 abc\nxyz\r\nChapter 3 of it\n1. Alpha\n1.2. beta\n12 Next\n    if (a) {\n    1. list() inside\n    | t | u |\n\n    b();",
    "a) one\n（一） two\n三、三\n##### marks\nÉCOLE\nªÉ\nx²\nnext\x0bvt\x85nel ls",
    None, "", "\n \n", "one",
]


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(LINES)], "doc_id long, text string, block int")
    found: dict = {}
    for r in sorted(N.typed(df).collect(), key=lambda r: (r.doc, r.block)):
        found.setdefault(r.doc, []).append((r.block, r.type, r.level, r.content))
    assert found == {i: b for i, t in enumerate(LINES) if (b := lines(t))}
    assert N.typed(df.limit(0)).count() == 0


def test_lines_on_the_whole_small_table(spark):
    found = {(r.doc, r.block): (r.type, r.level, r.digest) for r in registry.QUERIES["text_lines"](spark, SF).collect()}
    assert found == {(i, k): (t, n, md5(c)) for i, text in documents().items() for k, t, n, c in lines(text)}


def rows_of(blocks, tolerance=10):
    """blocks: (id, x, y); the height at which each block's row begins."""
    out, start = {}, None
    for b, _, y in sorted(blocks, key=lambda r: r[2]):
        if start is None or y - start > tolerance:
            start = y
        out[b] = start
    return out


def columns_of(blocks):
    xs = sorted({x for _, x, _ in blocks})
    gaps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    return 1 + sum(g > 2 * sum(gaps) / len(gaps) for g in gaps) if len(blocks) >= 3 and gaps else 1


def test_layout_on_the_whole_small_table(spark):
    pages: dict = {}
    for r in structure._boxes(spark, SF).collect():
        pages.setdefault(r.page, []).append((r.block, r.x, r.y))
    for r in registry.QUERIES["layout_order"](spark, SF).collect():
        blocks = pages[r.page]
        if not isinstance(blocks, dict):
            n, rows = columns_of(blocks), rows_of(blocks)
            key = (lambda b: (b[2], b[0])) if n == 1 else (lambda b, rows=rows: (rows[b[0]], b[1], b[0]))
            pages[r.page] = {b[0]: (n, rows[b[0]], k + 1) for k, b in enumerate(sorted(blocks, key=key))}
        assert (r.columns, r.row_y, r.place) == pages[r.page][r.block]


def test_layout_of_odd_pages(spark):
    rng = random.Random(1)
    pages = {"a": [(i, rng.choice([0, 5, 300]), rng.randint(0, 60)) for i in range(80)], "b": [(0, 1, 1), (1, 9, 12)], None: [(0, 0, 0), (1, 100, 11), (2, 210, 11)], "c": [(0, 3, 7)]}
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], "page string, block int, x int, y int")
    found = {(r.page, r.block): (r.columns, r.row_y) for r in L.reading_order(df, "page", "block", "x", "y").collect()}
    assert found == {(p, b): (columns_of(bs), y) for p, bs in pages.items() for b, y in rows_of(bs).items()}


FORMULAS = [
    r"Let $\frac{a}{b} + \sqrt{x_1} = \alpha^2$ and $$E = m^3$$, so E = m*c^2 - 1; F=G.",
    "cost $5 and $6 then $7", "A = B = C", "no formula", "", None, "X = a / b + sin(y), X = a / b", r"$\unknown{q}^n$ $\sum$", "É = 2 and Z = é+1",
]


def formulas(text):
    return [(n, m.start(), m[0], m[0] if n == "equation" else m[1]) for n, p in M.FORMULAS for m in re.finditer(p, text or "")]


def in_words(kind, f):
    if kind == "equation":
        sides = f.split("=")
        if len(sides) != 2:
            return f
        right = sides[1].strip()
        for sign, word in M.OPERATORS:
            right = right.replace(sign, word)
        return f"{sides[0].strip()} equals {right}"
    for p, put in M.LATEX:
        f = re.sub(p, put.replace("$1", r"\1").replace("$2", r"\2"), f)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+", "", f)).strip()


def explained(text):
    out = text or ""
    for kind, _, raw, f in sorted(formulas(text), key=lambda x: -x[1]):
        out = out.replace(raw, f"{raw} [{in_words(kind, f)}]", 1)
    return out


def relations(f):
    sides = [s.strip() for s in f.split("=")]
    if len(sides) != 2:
        return []
    a, b = (re.findall(r"\b[a-zA-Z]\b", s) for s in sides)
    return [(x, "EQUALS", y) for x in a for y in b] + ([(sides[0], "DEPENDS_ON", y) for y in b] if re.search(r"[*/]", sides[1]) else [])


def test_formulas(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FORMULAS)], "i int, t string")
    for r in df.select("t", M.formulas("t").alias("f"), M.explained("t").alias("e")).collect():
        assert [tuple(x) for x in r.f] == formulas(r.t) and r.e == explained(r.t)


def test_formula_queries_on_the_whole_small_table(spark):
    texts = {r.p_partkey: r.text for r in structure._formula_texts(spark, SF).collect()}
    split = lambda p, f, flags=0: " ".join(sorted(set(re.findall(p, f, flags))))
    want = sorted((k, n, at, raw, in_words(n, f), split(r"\b[a-zA-Z]\b", f), split(r"[+\-*/^=]", f), split(r"\b\d+\.?\d*\b", f), split(M.FUNCTIONS, f)) for k, t in texts.items() for n, at, raw, f in formulas(t))
    columns = ["p_partkey", "type", "position", "raw", "words", "variables", "operators", "constants", "functions"]
    assert sorted(map(tuple, registry.QUERIES["text_formulas"](spark, SF).select(columns).collect())) == want
    assert {r.p_partkey: r.text for r in registry.QUERIES["text_formulas_explained"](spark, SF).collect()} == {k: explained(t) for k, t in texts.items()}
    related = sorted((k, f, *r) for k, t in texts.items() for _, _, _, f in formulas(t) for r in relations(f))
    assert sorted(map(tuple, registry.QUERIES["graph_formula_relations"](spark, SF).collect())) == related


def walk(item, numbers, key="content"):
    if isinstance(item, str):
        low = key.strip().lower()
        return item if low in J.STRUCTURAL or low in J.PAYLOAD or (low == "url" and item.startswith("data:")) else hide(item, numbers)
    if isinstance(item, list):
        return [walk(x, numbers, key) for x in item]
    if isinstance(item, dict):
        return {k: walk(v, numbers, k) for k, v in item.items()}
    return item


def hide(text, numbers):
    for kind, p in V.CONFIDENTIAL:
        def put(m, kind=kind):
            form = m[0].strip()
            seen = numbers.setdefault(kind, [])
            form = form.lower() if kind in V.ANY_CASE else form
            if form not in seen:
                seen.append(form)
            return f"<{kind}_{seen.index(form) + 1}>"
        text = re.sub(p, put, text)
    return text


MESSAGES = [
    {"role": "a@b.org", "content": "mail a@b.org and sk-abcdefgh", "id": "x@y.org"},
    {"content": ["token: abcd", {"type": "text", "text": "see HTTPS://h.org/x a@B.org"}, {"url": "data:a@b.org", "image_url": {"url": "https://h.org/x"}}], "n": [1, 2.50, None, True, "c@d.org"]},
    ["sk-zzzzzzzz", "password=1234", "sk-zzzzzzzz", {" Role ": ["q@q.org", {"k": "q@q.org"}, "r@r.org"]}],
    "plain a@b.org", [], {}, {"a": {"b": {"c": ["\"quoted\" \\ a@b.org\n", "é a@b.org"]}}}, 5, None,
]


def test_messages(spark):
    texts = [json.dumps(m, ensure_ascii=False) for m in MESSAGES] + ["not json a@b.org, a@b.org", "", '{"broken": "a@b.org"', "[" * 5000, '  {"a" : "a@b.org" , "a":"c@d.org","n":1.0e5 }']
    rows = J.redacted(spark.createDataFrame([(i, t, "a@b.org") for i, t in enumerate([*texts, None])], "i int, t string, message string"), "t").collect()
    found = {r.i: r.t for r in rows}
    assert {r.message for r in rows} == {"a@b.org"}
    for i, m in enumerate(MESSAGES):
        assert json.loads(found[i]) == walk(m, {})
    k = len(MESSAGES)
    assert [found[k + j] for j in range(4)] == ["not json <EMAIL_1>, <EMAIL_1>", "", '{"broken": "<EMAIL_1>"', "[" * 5000]
    assert found[k + 4] == '  {"a" : "<EMAIL_1>" , "a":"<EMAIL_2>","n":1.0e5 }' and found[k + 5] == ""


def test_messages_are_taken_apart_some_at_a_time(monkeypatch):
    monkeypatch.setattr(J, "CHARACTERS", 40)
    messages = ['{"a": "x@y.org"}', "", "not json", '["' + "b" * 100 + '"]', "[]", '"q"', '{"a": "é"}']
    read: list = []

    def batches():
        read.append(pa.RecordBatch.from_arrays([pa.array(range(len(messages))), pa.array(messages)], names=["row", "message"]))
        yield read[0]

    parts = J._found(batches())
    first = next(parts)
    assert first.num_rows < len(messages)
    parts = [first, *parts]
    rows = pa.Table.from_batches(parts).to_pylist()
    assert len(parts) > 1 and [r["message"] for r in rows] == messages and [r["row"] for r in rows] == list(range(len(messages)))
    assert [[(f["begin"], f["end"], f["text"]) for f in r["found"]] for r in rows] == [J.leaves(m) for m in messages]
    sizes = [[len(m.as_py().encode()) for m in p.column(1)] for p in parts]
    assert all(sum(x) - max(x) <= 40 for x in sizes)


def test_only_changed_texts_go_back_to_their_messages(spark, monkeypatch):
    put, seen = J._put, spark.sparkContext.accumulator(0)

    def counted(batches):
        def each():
            for batch in batches:
                seen.add(sum(len(c) for c in batch.column(2).to_pylist()))
                yield batch

        return put(each())

    monkeypatch.setattr(J, "_put", counted)
    rows = [('["one", "a@b.org", "two"]',), ('"three"',), ("four a@b.org",)]
    found = J.redacted(spark.createDataFrame(rows, "t string"), "t").collect()
    assert sorted(r.t for r in found) == ['"three"', '["one", "<EMAIL_1>", "two"]', "four <EMAIL_1>"] and seen.value == 2


def test_message_query_on_the_whole_small_table(spark):
    rows = {r.message: r.digest for r in registry.QUERIES["text_redacted_messages"](spark, SF).collect()}
    for r in pq.read_table(f"{SF}/events.parquet").to_pylist():
        assert rows[f"event-{r['event_id']}"] == md5(r["props"])
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        numbers: dict = {}
        dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        mail, text = f"user{r['conv_id']}@example.org", r["text"] or ""
        part = {"type": "text", "text": f"{text} mail {mail}"}
        link = {"type": "image_url", "image_url": {"url": f"https://host/{r['turn']}", "data": "password: abcd"}}
        whole = {"role": r["role"], "content": {"parts": [dump(part), dump(link)], "content": [part]}, "id": mail, "note": mail}
        assert rows[f"turn-{r['conv_id']}-{r['turn']}"] == md5(dump(walk(whole, numbers)))


def test_deletion_is_consistent(spark):
    stores = {
        "chunks": spark.createDataFrame([(1, "a", "p1"), (2, "a", "p2"), (3, "b", "p3"), (4, "b", "p1"), (5, None, None), (6, "c", "p9")], "chunk int, source string, parent_id string"),
        "parents": spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b"), ("p4", None)], "parent_id string, source string"),
        "registry": spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "source string"),
        "mentions": spark.createDataFrame([("X", "a"), ("Y", "b"), ("Z", "a"), ("Q", None)], "entity string, source string"),
        "edges": spark.createDataFrame([("X", "r", "Y", ["a", "b"], 0.5), ("X", "r", "Z", ["a"], 0.1), ("W", "r", "W", ["c"], 0.2), ("V", "r", "V", [], 0.3)], "head string, relation string, tail string, sources array<string>, w double"),
        "entities": spark.createDataFrame([("X",), ("Y",), ("Z",), ("W",), ("Q",), ("lone",)], "entity string"),
    }
    after = D.without_sources(stores, spark.createDataFrame([("a",), ("a",), (None,), ("nowhere",)], "source string"))
    assert {r.chunk for r in after["chunks"].collect()} == {3, 5, 6} and {r.parent_id for r in after["parents"].collect()} == {"p3", "p4"}
    assert {r.source for r in after["registry"].collect()} == {"b", None, "c"} and {r.entity for r in after["entities"].collect()} == {"X", "Y", "W", "Q"}
    assert {(r["head"], r["tail"], tuple(r["sources"]), r["w"]) for r in after["edges"].collect()} == {("X", "Y", ("b",), 0.5), ("W", "W", ("c",), 0.2)}
    found = {r.store: (r.removed, r.rows) for r in D.counts(stores, after).collect()}
    assert found == {"chunks": (3, 3), "parents": (2, 2), "registry": (1, 3), "mentions": (2, 2), "edges": (2, 2), "entities": (2, 4)}
    same = D.without_sources(stores, stores["registry"].limit(0))
    assert same["chunks"].count() == 6 and same["mentions"].count() == 4


FLIGHTS = [("k", 0.0, False), ("k", 1.0, False), ("k", 2.0, True), ("k", 2.5, True), ("k", 3.0, False), ("k", 13.0, False), ("k", 13.5, False), ("k", 30.0, True), ("j", 0.0, True), ("j", 5.0, False)]
OUTCOMES = ["granted", "refused", "closed", "idle", "granted", "refused", "granted", "idle", "idle", "granted"]


def test_single_flight_in_batch_and_stream(spark, tmp_path):
    make = lambda: limits.InFlight(10)
    rows = limits.decided(spark.createDataFrame(FLIGHTS, "k string, t double, done boolean"), "k", ["t"], make, "outcome string").collect()
    want = {(*f, o) for f, o in zip(FLIGHTS, OUTCOMES, strict=True)}
    assert set(map(tuple, rows)) == want
    for i in range(2):
        spark.createDataFrame(FLIGHTS[5 * i : 5 * i + 5], "k string, t double, done boolean").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema("k string, t double, done boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limits.stateful(stream, "k", make, "outcome string", idle_seconds=None).writeStream.format("memory").queryName("flights").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        assert {tuple(r) for r in spark.sql("SELECT * FROM flights").collect()} == want
    finally:
        q.stop()


def test_single_flight_on_the_whole_small_table(spark):
    found = {r.event_id: r.outcome for r in registry.QUERIES["stream_single_flight"](spark, SF).collect()}
    since: dict = {}
    for r in sorted(pq.read_table(f"{SF}/events.parquet").to_pylist(), key=lambda r: (r["ts"], r["event_id"])):
        u, t = r["user_id"], r["ts"].timestamp()
        before = since.get(u)
        if before is not None and t - before > 6 * 3600:
            before = None
        if r["event_type"] == "purchase":
            want, since[u] = ("idle" if before is None else "closed"), None
        else:
            want, since[u] = ("granted" if before is None else "refused"), t if before is None else before
        assert found[r["event_id"]] == want
