"""Entity rules, names, expansion and agreement against plain Python."""

import re

import pyarrow.parquet as pq
import pytest

from sparkloom.operators import entities as E
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()
ODD = "A.I. and LLMs: GPT-4 uses Python3 at IBM. The Deep Learning Model; neural NETWORK 网络安全 大模型 it's Über-Fast AIs X-1 a DEEP model OF gpt-4"


def java(p):
    return p.replace(r"\x{4e00}-\x{9fff}", "一-鿿")


def by_rules(text):
    seen, out = set(), []
    for k, (name, confidence, pattern) in enumerate(E.RULES):
        for at, m in enumerate(re.finditer(java(pattern), text or "")):
            x = m.group()
            if name == "acronym":
                x = x.replace(".", "")
            stop = x.lower() in E.STOP_WORDS
            if {"acronym": len(x) < 2 or stop, "technical": len(x) < 3 or stop or not re.search("[-0-9]", x), "proper_noun": stop, "chinese": False, "technical_phrase": len(x) < 4 or stop}[name] or x.lower() in seen:
                continue
            seen.add(x.lower())
            out.append((-confidence, k, at, x, name))
    return [(i + 1, x, name, -c) for i, (c, _, _, x, name) in enumerate(sorted(out))]


def names(text, most):
    found = {}
    for k, p in enumerate(E.NAMES):
        for x in re.findall(java(p), text or ""):
            if k > 1 or (2 <= len(x) <= 50 and x not in E.NO_NAMES):
                found[x] = found.get(x, 0) + 1
    return [(i + 1, x, found[x]) for i, x in enumerate(sorted(found, key=lambda x: (-len(x), x))[:most])]


def normal(x):
    low = x.lower().strip()
    bare = low.replace(".", "")
    for key in (low, bare, bare[:-1] if bare.endswith("s") and len(bare) > 2 else bare):
        if key in E.ALIASES:
            return E.ALIASES[key]
    return low


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def agreed(ours, theirs):
    """ours, theirs: (text, confidence) in order."""
    known = {}
    for t, c in theirs:
        known.setdefault(t.strip().lower(), [t.strip(), c, False])
    new = []
    for t, c in ours:
        low = t.strip().lower()
        near = [(distance(low, k), i, k) for i, k in enumerate(known) if abs(len(k) - len(low)) <= 2]
        hit = low if low in known else min((x for x in near if x[0] <= 2), default=(0, 0, None))[2]
        if hit is None:
            new.append((t.strip(), c, False, True))
        else:
            known[hit][1:] = [min(1.0, known[hit][1] * 1.15), True]
    return sorted([(t, round(c, 6), b, False) for t, c, b in known.values()] + [(t, round(c, 6), b, o) for t, c, b, o in new])


def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(key(r))
    return {k: sorted(v) for k, v in out.items()}


def test_rules_on_the_whole_small_table(spark):
    rows = registry.QUERIES["entities_rules"](spark, SF).select("doc", "place", "text", "type", "confidence", "name").collect()
    want = {i: [(p, x, n, c, normal(x)) for p, x, n, c in by_rules(t)] for i, t in documents().items()}
    assert grouped(rows, lambda r: tuple(r)[1:]) == {i: w for i, w in want.items() if w}


def test_names_on_the_whole_small_table(spark):
    rows = registry.QUERIES["entities_names"](spark, SF).select("doc", "place", "text", "count").collect()
    assert grouped(rows, lambda r: tuple(r)[1:]) == {i: w for i, t in documents().items() if (w := names(t, 10))}


def test_agreement_on_the_whole_small_table(spark):
    rows = registry.QUERIES["entities_agreed"](spark, SF).select("doc", "text", "confidence", "by_both", "ours").collect()
    want = {i: agreed([(x, c) for _, x, _, c in by_rules(t)], [(x, min(0.95, 0.5 + 0.05 * n)) for _, x, n in names(t, 40)]) for i, t in documents().items()}
    assert grouped(rows, lambda r: tuple(r)[1:]) == {i: w for i, w in want.items() if w}


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, ODD, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", "x"), (5, "The This that", "x"), (6, "ﬁnés ÉCOLE IBMé été", "x")], "doc_id long, text string, rule string")
    rows = E.by_rules(docs).select("doc", "place", "text", "type", "confidence").collect()
    assert grouped(rows, lambda r: tuple(r)[1:]) == {i: w for i, t in ((1, ODD), (4, "nothing here"), (5, "The This that"), (6, "ﬁnés ÉCOLE IBMé été")) if (w := by_rules(t))}
    assert ("A.I." not in {r.text for r in rows}) and {r.type for r in rows if r.text.lower() == "gpt-4"} == {"technical"}
    assert grouped(E.names(docs).select("doc", "place", "text", "count").collect(), lambda r: tuple(r)[1:])[1] == names(ODD, 10)
    assert E.by_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "want"), [("A.I.", "artificial intelligence"), (" LLMs ", "large language model"), ("ais", "artificial intelligence"), ("Other.S", "other.s"), (None, ""), ("网络安全", "cybersecurity")])
def test_normal_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "x string").select(E.normal_name("x")).first()[0] == want


def test_agreement_of_near_forms(spark):
    ours = [(1, 1, "Postgres", 0.9), (1, 2, "Kafka", 0.8), (1, 3, "kafak", 0.7), (1, 4, "Redis", 0.7), (2, 1, "Kafka", 0.8)]
    theirs = [(1, 1, "postgers", 0.9), (1, 2, "KAFKA", 0.95), (1, 3, "kafka", 0.2)]
    columns = "doc long, place int, text string, confidence double"
    rows = E.agreed(spark.createDataFrame(ours, columns), spark.createDataFrame(theirs, columns)).collect()
    found = sorted((r.doc, r.text, round(r.confidence, 6), r.by_both, r.ours) for r in rows)
    assert found == [(1, "KAFKA", 1.0, True, False), (1, "Redis", 0.7, False, True), (1, "postgers", 1.0, True, False), (2, "Kafka", 0.8, False, True)]


def test_expansion(spark):
    asked = spark.createDataFrame([(1, "What is ML in AI ?"), (2, "no entity"), (3, "ML"), (4, None), (5, "ML machine learning")], "query long, text string")
    words = spark.createDataFrame([("ml", ["machine learning", "Meta Language"]), ("ai", ["artificial intelligence", "MACHINE LEARNING"]), ("ML", ["unused"])], "term string, synonyms array<string>")
    found = {r.query: r.expanded for r in E.expanded(asked, words).collect()}
    assert found == {1: "What is ML in AI ? machine learning Meta Language artificial intelligence", 2: "no entity", 3: "ML machine learning Meta Language", 4: "", 5: "ML machine learning Meta Language"}


def test_agreement_of_long_forms(spark):
    """Before, a form of n characters became n * n / 2 forms of its length, so these didn't end."""
    a, b = "Ab" + "Cde" * 2000, "Xy" + "Zuv" * 2000
    columns = "doc long, place int, text string, confidence double"
    ours = [(i, k, x + str(k), 0.5) for i in range(4) for k, x in enumerate((a, b, "abcdefgh", "abcdef"))]
    theirs = [(i, k, x, 0.6) for i in range(4) for k, x in enumerate((a[:-1], "Q" + b[2:] + "9", "abcdefgh", "abcdefg"))]
    found = {(r.doc, r.text): (r.by_both, r.ours, round(r.confidence, 6)) for r in E.agreed(spark.createDataFrame(ours, columns), spark.createDataFrame(theirs, columns)).collect()}
    want = {a[:-1]: (True, False, 0.69), "Q" + b[2:] + "9": (False, False, 0.6), "abcdefgh": (True, False, 0.69), "abcdefg": (True, False, 0.69), b + "1": (False, True, 0.5)}
    assert found == {(i, t): w for i in range(4) for t, w in want.items()}
