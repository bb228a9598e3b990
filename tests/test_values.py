"""Values of the registered queries that have no SQL, on whole small tables, against plain Python."""

import hashlib
import hmac
import json
import re

import pyarrow.parquet as pq
from test_cascade import dates, numbers, unmatched

from sparkloom.functions import rules as U
from sparkloom.functions import text as T
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def python(p):
    return p.replace(r"\x{4e00}-\x{9fff}", "一-鿿")


def rewrites(text):
    q = (text or "").strip(" ")
    if not q:
        return []
    words = [w for w in dict.fromkeys(re.findall(python(T.REWRITE_TOKEN), (text or "").lower())) if w not in T.REWRITE_STOP_WORDS][:8]
    out = [q]
    if len(words) >= 2:
        short = " ".join(words[: max(2, min(4, len(words) - 1))])
        out += [x for x in (" ".join(words) if " ".join(words) != q else None, short if short.lower() != q.lower() else None) if x]
    return list(dict.fromkeys(out))


def test_rewrites(spark):
    found: dict = {}
    for r in sorted(rows(spark, "rules_rewrites"), key=lambda r: (r.item_id, r.variant)):
        found.setdefault(r.item_id, []).append(r.query)
    assert found == {r["item_id"]: rewrites(r["text"]) for r in table("benchmark") if rewrites(r["text"])}


def claims(text):
    out = []
    for s in re.split(r"[.!?。！？]\s*", text or ""):
        s = s.strip(" ")
        if len(s) < 10:
            continue
        clean = re.sub(r"\s+", " ", re.sub(r"\s*\[[^\]]+\]\s*", " ", s)).strip(" ")
        cited = [c for c in re.findall(r"\[([^\]]+)\]", s) if re.search(r"^doc\w*:\w+", c)]
        out.append((md5(clean), len(cited), "date" if dates(clean) else "number" if numbers(clean) else "negation" if re.search(U.CLAIM_NEGATION, clean) else "general"))
    return out


def test_claims(spark):
    found: dict = {}
    for r in sorted(rows(spark, "rules_claims"), key=lambda r: (r.conv_id, r.turn, r.i)):
        found.setdefault((r.conv_id, r.turn), []).append((r.digest, r.citations, r.kind))
    want = {(r["conv_id"], r["turn"]): claims(r["text"]) for r in table("conversations") if r["role"] == "assistant"}
    assert found == {k: v for k, v in want.items() if v}


def test_numbers(spark):
    want, before = {}, {}
    for r in sorted(table("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        a, s = r["text"] or "", before.get(r["conv_id"]) or ""
        want[r["conv_id"], r["turn"]] = (len(unmatched(numbers(a), numbers(s))), len(dates(a) - dates(s)))
        before[r["conv_id"]] = r["text"]
    assert {(r.conv_id, r.turn): (r.numbers, r.dates) for r in rows(spark, "verify_numbers")} == want


def level(line):
    t = line.strip(" ")
    upper = lambda c: c.isupper() and c.isalpha()
    marks = len(t) - len(t.lstrip("#"))
    dots = re.match(r"((?:\d+\.)+)\s+[A-Z]", t)
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    if not t:
        return None
    if 1 <= marks <= 6 and t.lstrip("#").strip(" "):
        return marks
    if dots:
        return min(6, dots[1].count("."))
    if any(map(upper, t)) and not any(c.islower() for c in t) and 5 <= len(t) <= 100:
        return 1
    if upper(t[0]) and t[-1] not in ".!?," and 2 <= len(words) <= 15 and sum(upper(w[0]) for w in words) / len(words) > 0.6:
        return 2
    return None


def sections(text):
    out, stack = [(0, None, None, [], None)], []
    for line in (text or "").split("\n"):
        n = level(line)
        if n is None:
            out[-1][3].append(line)
            continue
        stack = [s for s in stack if s[1] < n]
        out.append((len(out), n, line.strip(" "), [], stack[-1][0] if stack else None))
        stack.append((len(out) - 1, n))
    lines = (text or "").split("\n")
    first = [] if level(lines[0]) is None else [0]
    return {(s, n, t, md5("\n".join(body)), p) for s, n, t, body, p in out if s not in first or body}


def test_sections(spark):
    found: dict = {}
    for r in rows(spark, "structure_sections"):
        found.setdefault(r.doc, set()).add((r.section, r.level, r.title, r.digest, r.parent))
    assert found == {r["doc_id"]: sections(r["text"]) for r in table("documents")}


def test_hash_chain(spark):
    want, last = {}, {}
    for r in sorted(table("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        before = last.get(r["conv_id"], "")
        content = json.dumps({"content": "|".join(x for x in (r["role"], r["text"]) if x is not None), "prev": before}, sort_keys=True, ensure_ascii=False)
        last[r["conv_id"]] = hmac.new(b"key", content.encode(), hashlib.sha256).hexdigest()
        want[r["conv_id"], r["turn"]] = (before, last[r["conv_id"]])
    assert {(r.conv_id, r.turn): (r.prev_hash, r.hash) for r in rows(spark, "stream_hash_chain")} == want
