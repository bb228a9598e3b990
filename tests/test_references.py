"""Ordered windows, pronouns and page tables against plain loops."""

import hashlib
import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ordered
from sparkloom.operators import pages as P
from sparkloom.operators import references as R
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_blocks_don_t_show(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, i]), [f"{i}-{k}" for k in range(rng.choice([0, 0, 0, 1, 2, 7]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, v int, items array<string>").repartition(5)
    block = F.floor(F.col("at") / width)
    out = ordered.numbered(df, ["k"], ["at"], block)
    out = ordered.carried(out, ["k"], ["at"], block, F.col("v"), "with")
    out = ordered.carried(out, ["k"], ["at"], block, F.col("v"), "without", with_own=False)
    out = ordered.recent(out, ["k"], ["at"], block, F.col("items"), 5)
    state, want = {}, {}
    for k, at, v, items in rows:
        n, last, register = state.get(k, (0, None, []))
        new = v if v is not None else last
        register = (register + items)[-5:]
        want[at] = (n + 1, new, last, register)
        state[k] = (n + 1, new, register)
    assert {r.at: (r.place, r["with"], r["without"], r.recent) for r in out.collect()} == want


def mentioned(sentence):
    out = {}
    for p in R.ENTITIES:
        for x in re.findall(p, sentence):
            out.setdefault(x.lower(), x)
    return list(out.values())


def sentences(text):
    return [x.strip() for x in re.split(r"[.!?]+\s+", text or "") if x.strip()]


def replaced(sentence, recent):
    if not recent:
        return sentence
    last = recent[-1]
    sentence = re.sub(r"\bIt\b", last, sentence, count=1)
    sentence = re.sub(r"\bit\b", last.lower(), sentence, count=1)
    for word in ("This", "That"):
        sentence = re.sub(rf"\b{word}\b(?=\s+(?:is|was|has|can|will))", last, sentence, count=1)
    return re.sub(r"\bThey\b", f"{recent[-2]} and {last}", sentence, count=1) if len(recent) > 1 else sentence


def resolved(turns):
    """turns: (conversation, turn, text); the result by all three."""
    out, state = {}, {}
    for c, t, text in sorted(set(turns), key=lambda r: (str(r[0]), r[1], r[2])):
        recent, done = state.get(c, []), []
        for s in sentences(text):
            recent = (recent + mentioned(s))[-5:]
            done.append(replaced(s, recent))
        state[c] = recent
        out[c, t, text] = " ".join(done)
    return out


def question(q, entities):
    for e in entities:
        for p in R.QUESTION_PRONOUNS:
            if re.search(p, q):
                q = re.sub(p, lambda m, e=e: e, q, count=1)
                break
    return q


CHAT = [
    (1, 0, "The Kafka Broker failed. It was slow! They restarted it and it came back."),
    (1, 1, "This is odd. That has a USD problem. IT is fine"),
    (1, 2, ""), (1, 3, "They will see. it is, and It was."), (1, 200, "it again"), (1, 200, "it again"), (1, 200, "a Second text. It"),
    (2, 0, "they say it is. Nothing"), (3, 0, None), (None, 0, "The DataModel. It"), (None, 1, "it\n\tis"), (4, 5, "ÉCOLE système. it's"),
]


def conversations():
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]


@pytest.mark.parametrize("block", [1, 64])
def test_odd_conversations(spark, block):
    rows = R.resolved(spark.createDataFrame(CHAT, "conv long, turn long, say string"), "conv", "turn", "say", block=block).collect()
    want = resolved([(c, t, s or "") for c, t, s in CHAT])
    assert {(r.conv, r.turn, r.say): r.resolved for r in rows} == want and len(rows) == len(want)


def test_resolved_query_on_the_whole_small_table(spark):
    want = resolved([(c, t, s or "") for c, t, _, s in conversations()])
    found = {(r.conv_id, r.turn, r.said): r.resolved for r in registry.QUERIES["chat_resolved"](spark, SF).collect()}
    assert found == {(c, t, md5(s)): md5(x) for (c, t, s), x in want.items()}


def test_questions_on_the_whole_small_table(spark):
    turns: dict = {}
    for c, t, role, s in conversations():
        turns.setdefault(c, []).append((t, s or "", role))
    want = {}
    for c, rows in turns.items():
        rows = sorted(set(rows))
        for i, (t, s, role) in enumerate(rows):
            if role == "user":
                named = list(itertools.chain(*(mentioned(x) for _, x, _ in rows[max(0, i - 10) : i])))
                order = sorted(dict.fromkeys(named), key=lambda e: -named.count(e))
                want[c, t, md5(s)] = md5(question(s, order))
    assert {(r.conv_id, r.turn, r.said): r.resolved for r in registry.QUERIES["chat_questions"](spark, SF).collect()} == want


def test_questions_with_pronouns(spark):
    chat = [(1, 0, "user", "Tell me of Kafka and Flink"), (1, 1, "assistant", "Kafka is a System"), (1, 2, "user", "Is it as fast as that, 它 or this?"), (2, 0, "user", "it?")]
    rows = R.resolved_questions(spark.createDataFrame(chat, "c long, t long, role string, text string"), F.col("role") == "user", "c", "t", "text").collect()
    found = {(r.c, r.t): r.resolved for r in rows}
    assert found[1, 2] == question(chat[2][3], ["Kafka", "Tell", "Flink", "System"]) and found[2, 0] == "it?" and len(found) == 3


def context(text):
    stack, out = [], []
    for s in sentences(text):
        for e in mentioned(s):
            if e not in stack:
                stack = (stack + [e])[-10:]
        out.append(f"[Context: {', '.join(stack[-3:])}] {s}" if stack else s)
    return " ".join(out)


def test_context_on_the_whole_small_table(spark):
    found = {r.doc_id: (r.context, r.nouns) for r in registry.QUERIES["text_context"](spark, SF).collect()}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        nouns = r["text"] or ""
        for p, put in R.DEMONSTRATIVES:
            nouns = re.sub(p, put, nouns, flags=re.IGNORECASE)
        assert found[r["doc_id"]] == (md5(context(r["text"])), md5(nouns))


RULE = re.compile(r"^\|[\s\-:]+\|")


def split(text):
    return [x.strip() for x in text.split("\n") if x.strip()]


def starts(text):
    ls = split(text)
    if len(ls) < 2:
        return False
    n = [x.count("|") for x in ls[:3]]
    return bool("|" in ls[0] and RULE.match(ls[1])) or (len(set(n)) == 1 and n[0] >= 2)


def continues(text):
    ls = split(text)
    n = [x.count("|") for x in ls[:5] if "|" in x]
    return len(n) >= 2 and len(set(n)) == 1 and n[0] >= 2 and not RULE.match(ls[1])


def open_end(text):
    ls = split(text)
    rows = [x for x in ls[-5:] if "|" in x]
    return len(ls) >= 3 and len(rows) >= 2 and len(rows) >= len(ls[-5:]) // 2 and "|" in ls[-1]


def head(text):
    run = list(itertools.takewhile(lambda x: "|" in x, itertools.dropwhile(lambda x: "|" not in x, text.split("\n"))))
    return any(RULE.match(x.strip()) for x in run[1:])


def put_together(pages, test, put):
    out, i = [], 0
    while i < len(pages):
        if i + 1 < len(pages) and test(pages[i][1], pages[i + 1][1]):
            out.append((pages[i][0], put(pages[i][1], pages[i + 1][1]), 2))
            i += 2
        else:
            out.append((*pages[i][:2], 1))
            i += 1
    return out


def whole(pages):
    return put_together(pages, lambda a, b: open_end(a) and continues(b), lambda a, b: a + "\n" + b)


def joined(pages):
    return put_together(pages, lambda a, b: (starts(a) or "|" in a) and continues(b), lambda a, b: a + "\n" + ("\n".join(x for x in b.split("\n") if "|" in x) if head(a) else b))


HEAD, ROWS, PROSE = "Intro\n| a | b |\n|---|---|\n| 1 | 2 |", "| 3 | 4 |\n| 5 | 6 |\n| 7 | 8 |", "only prose\nhere"
PAGES = [HEAD, ROWS, ROWS, ROWS, PROSE, ROWS, ROWS, HEAD, ROWS, "", ROWS, "| x |\n| y | z |", ROWS + "\ntail", ROWS, " | 3 | 4 |\n\n| 5 | 6 |", "|\n|", "|--|\n|--|\n|--|"]


@pytest.mark.parametrize("width", [1, 5, 4096])
@pytest.mark.parametrize(("ours", "plain"), [(P.with_whole_tables, whole), (P.with_joined_tables, joined)])
def test_pages_are_put_together_in_pairs(spark, width, ours, plain):
    rng = random.Random(width)
    docs = {"a": list(enumerate(PAGES)), "b": [(i, rng.choice(PAGES)) for i in range(60)], None: [(i, ROWS) for i in range(7)], "c": [(0, HEAD)]}
    df = spark.createDataFrame([(s, i, t) for s, ps in docs.items() for i, t in ps], "s string, n long, body string").repartition(4)
    rows = ours(df, "s", "n", "body", F.floor(F.col("n") / width)).collect()
    assert sorted(((r.s, r.n, r.body, r.pages) for r in rows), key=str) == sorted(((s, *x) for s, ps in docs.items() for x in plain(ps)), key=str)


def test_kinds_of_pages(spark):
    df = spark.createDataFrame([(t,) for t in PAGES], "t string")
    found = df.select("t", P.starts_table("t").alias("a"), P.continues_table("t").alias("b"), P.leaves_table_off("t").alias("c"), P.has_head("t").alias("d")).collect()
    assert [(r.a, r.b, r.c, r.d) for r in found] == [(starts(t), continues(t), open_end(t), head(t)) for t in (r.t for r in found)]


def test_page_query_on_the_whole_small_table(spark):
    by: dict = {}
    for r in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        by.setdefault(r["source"], []).append((r["doc_id"], r["text"] or ""))
    want = {(s, i): (md5(t), n) for s, ps in by.items() for i, t, n in joined([x[:2] for x in whole(ps)])}
    assert {(r.source, r.doc_id): (r.digest, r.pages) for r in registry.QUERIES["page_tables"](spark, SF).collect()} == want


@pytest.mark.parametrize(("ours", "plain"), [(P.with_whole_tables, whole), (P.with_joined_tables, joined)])
def test_pages_of_one_place_are_put_together_in_the_order_of_their_texts(spark, ours, plain):
    rng = random.Random(3)
    docs = {s: sorted(((rng.choice([None, 0, 1, 2]), rng.choice(PAGES)) for _ in range(30)), key=lambda p: (p[0] is not None, p)) for s in ("a", None)}
    df = spark.createDataFrame([(s, i, t) for s, ps in docs.items() for i, t in ps], "s string, n long, body string").repartition(4)
    rows = ours(df, "s", "n", "body", F.floor(F.col("n") / 2)).collect()
    assert sorted(((r.s, r.n, r.body, r.pages) for r in rows), key=str) == sorted(((s, *x) for s, ps in docs.items() for x in plain(ps)), key=str)


def test_pages_without_tables_stay_where_they_lie(spark):
    """Texts of pages that can't go together aren't shuffled: the result reads them from the table."""
    plan = registry.QUERIES["page_tables"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
