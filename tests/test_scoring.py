"""Additive scores against plain Python."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_cascade import dates, numbers, unmatched

from sparkloom.operators import cascade
from sparkloom.operators import chunks as C
from sparkloom.operators import chunktypes as K
from sparkloom.operators import scoring as S
from sparkloom.plans import registry, scores

SF = "/root/testdata/sf0.001"
registry.load_all()
QUESTIONS = [
    "你好！", "谢谢", "What is the difference between A and B? How? Why?", "今天好累", "今天的天气怎么样？", "google 搜索一下", "latest release notes", "我在家", "嗯", "",
    None, "请总结以及分析流程步骤" * 4, "compare vs versus and or also plus", "list all steps of the process and explain why, in detail, furthermore", "你 [补全提示] 天气", "它和她的区别", "hey there",
    "Recent", "today", "how to do it in steps of some length please", "我 我 我 我 我 我 我 我 我 我 我 我 我", "ſhow ME", "帮我上网查", "is it or are they",
]


def complexity(t):
    low, n = t.lower(), len(t)
    q = sum(w in S.QUESTION_WORDS for w in low.split())
    c = sum(w in low for w in S.CONNECTORS)
    score = (0 if n < 15 else 1 if n < 40 else 2 if n < 80 else 3) + (0.5 if q == 0 else min(q - 1, 2)) + (2 if c >= 3 else 1 if c else 0) + (t.count("?") + t.count("？") > 1)
    score += min(3, sum(w for w, words in S.INDICATORS if any(x in low for x in words)))
    return score, "simple" if score <= 2 else "medium" if score <= 5 else "complex"


def decomposition(t):
    has = lambda words: any(w in t for w in words)
    needed = (("和" in t or "与" in t) and has(["区别", "对比", "比较", "difference", "compare"])) or has(["以及", "还有", "另外", "and also", "as well as"]) or len(t) > 50
    needed = needed or t.count("?") > 1 or t.count("？") > 1 or (has(S.SPLITS[1][1]) and len(t) > 30)
    return needed, next((n for n, words in S.SPLITS if has(words)), "general")


def asked(t):
    for m in S.AUGMENTED:
        t = t.split(m)[0]
    return t.strip().lower()


def hit(t, patterns):
    return any(re.search(p, t, re.IGNORECASE) for p in patterns)


def facts(t):
    return bool(t) and (hit(t, S.TASK) or hit(t, S.FACT) or "?" in t or "？" in t)


def web(t):
    t = asked(t)
    return bool(t) and (hit(t, S.FORCE_WEB) or (hit(t, S.FRESH) and not hit(t, S.CASUAL) and facts(t)))


def small_talk(t):
    low = asked(t)
    if not low or web(t) or hit(low, S.TASK):
        return False
    n = len(re.findall(r"[A-Za-z0-9_]+|[一-鿿]", low))
    return hit(low, S.CASUAL) or (not facts(low) and 0 < n <= 12 and any(x in low for x in ("你", "我", "咱们", "我们")))


def strategies(t):
    t = t or ""
    return (*complexity(t), *decomposition(t), web(t), small_talk(t))


def test_questions(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "i int, q string")
    rows = df.select("q", *S.complexity("q"), *S.decomposition("q"), S.needs_web("q"), S.small_talk("q")).collect()
    assert [tuple(r)[1:] for r in rows] == [strategies(r.q) for r in rows]


def test_strategies_on_the_whole_small_table(spark):
    want = {(r["conv_id"], r["turn"]): strategies(r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()}
    found = registry.QUERIES["question_strategies"](spark, SF).collect()
    assert {(r.conv_id, r.turn): (r.score, r.level, r.needed, r.how, r.web, r.small_talk) for r in found} == want


def answer_quality(t):
    score = 0.8 - (0.2 if len(t) < 100 else 0.1 if len(t) > 2000 else 0) - (0.1 if len(re.split("[。！？.!?]", t)) < 2 else 0) - (0.3 if any(f in t.lower() for f in S.FILLERS) else 0)
    return max(0.0, min(1.0, score))


def spans(t):
    return list(dict.fromkeys(x for p in S.SPANS for x in re.findall(p.replace(r"\x{4e00}-\x{9fff}", "一-鿿"), t)))[:5]


def support(claim, cited, has):
    if not has:
        return 0.3
    if not cited:
        return 0.2
    words, there = (set(re.findall(r"\b[a-z]{4,}\b", x.lower())) | set(re.findall("[一-鿿]{2,}", x)) for x in (claim, cited))
    score = 0.5
    if numbers(claim):
        score += 0.25 if numbers(cited) and not unmatched(numbers(claim), numbers(cited)) else -0.5
    if dates(claim):
        score += 0.25 if dates(claim) & dates(cited) else -0.5
    overlap = len(words & there) / len(words) if words else 0
    score += 0.25 if overlap > 0.5 else 0.15 if overlap > 0.3 else 0.05 if overlap > 0.15 else 0
    negation = re.compile(cascade.NEGATION.replace("(?iU)", "(?i)"))
    score -= 0.3 if bool(negation.search(claim)) != bool(negation.search(cited)) else 0
    return max(0.0, min(1.0, score))


def test_answers_on_the_whole_small_table(spark):
    found = {(r.conv_id, r.turn): (r.quality, r.spans, r.support) for r in registry.QUERIES["verify_answers"](spark, SF).collect()}
    want = {}
    for r in scores._checked(spark, SF).collect():
        text = next((d.content for d in r.docs if r.citations and d.doc == r.citations[0].doc), None)
        want[r.conv_id, r.turn] = (pytest.approx(answer_quality(r.answer)), "|".join(spans(r.answer)), pytest.approx(support(r.answer, text, bool(r.citations)), abs=1e-7))
    assert found == want and len({v[2] for v in found.values()}) > 2


@pytest.mark.parametrize(("claim", "cited"), [("It grew 5% in 2020", "growth of 5.1 percent in 2020"), ("Never failed", "it failed in 2019"), ("收入 增长 10M", "收入 增长 达到 10 million"), ("", "x"), (None, None), ("words without match at all", "other text")])
def test_claims(spark, claim, cited):
    row = spark.createDataFrame([(claim, cited)], "a string, b string").select(S.claim_support(F.col("a"), F.col("b"), F.lit(True)), S.answer_quality("a"), S.factual_spans("a")).first()
    assert row[0] == pytest.approx(support(claim or "", cited or "", True)) and row[1] == pytest.approx(answer_quality(claim or "")) and row[2] == spans(claim or "")


def keywords(q):
    if re.search("[一-鿿]", q):
        bare = re.sub("[^一-鿿a-zA-Z0-9]", "", q)
        return list({bare[i : i + k] for k in (1, 2, 3) for i in range(len(bare) - k + 1)})
    return [w for w in re.findall(r"\b\w+\b", q.lower()) if w not in S.STOP and len(w) > 2]


def quality(q, chunks):
    """chunks: (content, score, source)."""
    if not chunks:
        return (0, 0, 0, 0, 0)
    text, keys = " ".join(c or "" for c, _, _ in chunks).lower(), keywords(q or "")
    coverage = 0 if not q else 0.5 if not keys else sum(k.lower() in text for k in keys) / len(keys)
    best = sorted((0.5 if s is None else s for _, s, _ in chunks), reverse=True)[:3]
    relevance = max(0, min(1, sum(best) / len(best)))
    d = len({s or "unknown" for _, _, s in chunks}) / len(chunks)
    n = sum(len(c or "") for c, _, _ in chunks) / len(chunks)
    whole = 1 if n >= 300 else 0.6 + (n - 150) / 150 * 0.4 if n >= 150 else 0.3 + (n - 50) / 100 * 0.3 if n >= 50 else n / 50 * 0.3
    cut = sum(any(x in (c or "") for x in S.CUT_OFF) for c, _, _ in chunks) / len(chunks)
    parts = (coverage, relevance, d * (1 if d >= 0.8 else 0.9 if d >= 0.5 else 0.7), max(0, whole - cut * 0.2))
    return (*parts, sum(p * w for p, w in zip(parts, (0.30, 0.40, 0.15, 0.15), strict=True)))


def test_retrieval_quality(spark):
    cases = {
        0: ("What is Kafka and what of streams", [("Kafka is a log...", 0.9, "a"), ("unrelated", None, "a"), ("streams", 0.1, None), ("x" * 400, 2.0, "b")]),
        1: ("是什么 Kafka", [("Kafka 是 日志", 0.4, "a")]), 2: ("", [("text", 0.4, "a")]), 3: ("the of", [("text " * 40, 0.4, "a"), (None, 0.2, "a"), ("…", 0.3, "a")]), 4: ("nothing found", []), 5: (None, [("t", 1.0, "s")]),
    }
    queries = spark.createDataFrame([(i, q) for i, (q, _) in cases.items()], "query int, text string")
    chunks = spark.createDataFrame([(i, *c) for i, (_, cs) in cases.items() for c in cs], "query int, content string, score double, source string")
    found = {r[0]: tuple(r)[1:] for r in S.retrieval_quality(queries, chunks).collect()}
    assert found == {i: pytest.approx(quality(q, cs)) for i, (q, cs) in cases.items()}


def test_retrieval_quality_on_the_whole_small_table(spark):
    rows = registry.QUERIES["retrieve_quality"](spark, SF).collect()
    assert len(rows) == pq.read_table(f"{SF}/benchmark.parquet").num_rows
    assert all(0 <= v <= 1 for r in rows for v in tuple(r)[1:]) and all(r.overall == pytest.approx(0.3 * r.coverage + 0.4 * r.relevance + 0.15 * (r.diversity + r.completeness), abs=1e-7) for r in rows)


def signal(r):
    tokens = [r.entity[:4].lower(), "tion"]
    own = set(re.findall(r"[a-z0-9_\-]+|[一-鿿]{2,}", r.entity.lower()))
    relevance = min(1, (sum(t in own for t in tokens) + sum(0.5 for t in tokens for e in own if t in e or e in t)) / max(len(tokens), len(own))) if own else 0
    parts = [(0.35, (1 / 5 + relevance) / 2)]
    if r.neighbours:
        parts.append((0.4, min(1, r.neighbour_weight * 1.15) if r.quality >= 0.7 else r.neighbour_weight))
    if r.paths:
        parts.append((0.25, min(1, r.path_weight * 1.2)))
    score = min(1, sum(w * c for w, c in parts) / sum(w for w, _ in parts) * (0.9 + r.quality * 0.1))
    return pytest.approx(relevance, abs=1e-7), pytest.approx(score, abs=1e-7), "medium" if score >= 0.5 else "low"


def test_signals_on_the_whole_small_table(spark):
    want = {r.entity: signal(r) for r in scores._signals(spark, SF).collect()}
    assert {r.entity: (r.relevance, r.score, r.confidence) for r in registry.QUERIES["graph_signals"](spark, SF).collect()} == want


def test_confidence_and_weights(spark):
    df = spark.createDataFrame([(3, 1.0, 5, 1.0, 0, None, 1.0), (0, None, 0, None, 0, None, 1.0), (2, 0.1, 3, 0.1, 1, 0.1, 0.0)], "e int, r double, n int, nw double, p int, pw double, q double")
    rows = df.select(*S.graph_signal(*[F.col(c) for c in ("e", "r", "n", "nw", "p", "pw", "q")])).collect()
    assert [r[1] for r in rows] == ["high", "low", "medium"] and rows[1][0] == 0.0
    w = spark.createDataFrame([("Depends_On", 0.0), ("related", 1.0), ("near", 0.9), ("near", 0.5), (None, 1.0)], "r string, q double").select(S.relation_weight("r", F.col("q"))).collect()
    assert [x[0] for x in w] == [pytest.approx(v) for v in (1.0, 0.0, 0.78, 0.69, 0.0)]


def kind(t):
    has = lambda x, words: any(w in x for w in words)
    low, own = t.lower(), t.strip()
    if not t:
        return "paragraph"
    if (len(t) < 100 and not t.rstrip().endswith((".", "。", "!", "！", "?", "？")) and (t[0].isupper() or has(t, "第一二三四五六七八九十"))) or t.startswith("#"):
        return "heading"
    if t.startswith(("```", "    ")) or sum(w in t for w in K.CODE_WORDS) >= 2 or sum(t.count(s) for s in K.CODE_SIGNS) >= 5:
        return "code"
    lines = t.split("\n")
    if (t.count("|") >= 4 and len(lines) >= 2 and all("|" in x for x in lines[:3])) or "<table" in low or "<tr>" in low:
        return "table"
    said = own.split("\n")
    if len(said) >= 2 and any(sum(bool(re.match(p, x)) for x in said) >= 2 for p in K.LISTS):
        return "list"
    if t.startswith((">", "「", "“")) or has(low, K.QUOTES):
        return "quote"
    if any(re.match(p, own) for p in K.DEFINITIONS) or "(acronym)" in low or has(t, ["缩写", "全称"]):
        return "definition"
    if any(re.search(p, low) for p in K.STEPS) or sum(w in low for w in K.ORDER_WORDS) >= 2:
        return "procedure"
    return "metadata" if any(re.search(p, low) for p in K.METADATA) else "paragraph"


def top_words(t):
    words = [w for w in re.sub(r"[^\w\s]", " ", t.lower()).split() if len(w) > 3 and w not in K.NO_KEYWORDS]
    return sorted(dict.fromkeys(words), key=lambda w: -words.count(w))[:10]


def enriched(t, position):
    t = t or ""
    keys, found = top_words(t), {n: list(dict.fromkeys(re.findall(p, t)))[: K.MOST.get(n)] for n, p in K.ENTITIES.items()}
    code = any(w in t for w in ("```", "def ", "class ", "function"))
    score = K.WEIGHTS[kind(t)] + {"start": 0.1, "end": 0.05}.get(position, 0) + (-0.1 if len(t) < 50 else -0.05 if len(t) > 2000 else 0.05 if 200 <= len(t) <= 800 else 0)
    score += 0.05 * code + 0.05 * (len(keys) >= 3) + 0.05 * any(found.values())
    flags = ("?" in t or "？" in t, code, "http://" in t or "https://" in t, "@" in t and "." in t)
    return kind(t), len(t), len(t.split()), " ".join(keys), *(" ".join(found[n]) for n in K.ENTITIES), *flags, position, pytest.approx(max(0, min(1, score)))


CHUNKS = [
    "Heading line", "# x", "def f():\n  return 1\nand more text that goes on and on so that it is long enough to be no heading at all, really, it is.", "| a | b |\n| c | d |", "1. one\n2. two.",
    "- a thing.\n- another one.", "> said he.", "according to them it is so.", "Foo is a bar.", "数据：说明。", "first step 2 is here.", "第三步 做。", "finally it is next.", "author: me.", "ordinary text, nothing else.", "", None,
    "see https://x.org/a?b=1 and a@b.org, 10.0.0.1 and API, API or SDK 1.2.3 words words other. ", "É école: ça va?", "a) x.\nb) y.", "x {a} (b);=> z ok.",
]


def test_chunks(spark):
    df = spark.createDataFrame([(i, t, ["start", "middle", "end"][i % 3]) for i, t in enumerate(CHUNKS)], "i int, chunk string, position string")
    out = K.enriched(df, ["i"])
    rows = out.select("i", "type", "length", "word_count", F.array_join("keywords", " "), *[F.array_join(F.col("entities")[n], " ") for n in K.ENTITIES], "has_question", "has_code", "has_url", "has_email", "position", "importance").collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {i: enriched(t, ["start", "middle", "end"][i % 3]) for i, t in enumerate(CHUNKS)}


def test_chunks_on_the_whole_small_table(spark):
    found = registry.QUERIES["chunk_enriched"](spark, SF)
    rows = {(r.doc_id, r.chunk_index): tuple(r)[2:] for r in found.collect()}
    want = {}
    for d in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        text = d["text"] or ""
        parts = [text] if 0 < len(text) <= 600 else [text[a : a + 600] for a in range(0, max(len(text) - 120, 0), 480)]
        for i, t in enumerate(parts):
            want[d["doc_id"], i] = enriched(t, "start" if i == 0 else "end" if i == len(parts) - 1 else "middle")
    assert rows == want


@pytest.mark.parametrize("name", ["chunk_enriched", "chunk_neighbours"])
def test_chunks_are_told_of_where_they_lie(spark, name):
    """Neither chunks nor their words are shuffled."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_neighbours_of_chunks_before_and_after_they_are_parted(spark):
    docs = spark.createDataFrame([(i, "abcdefghij" * i) for i in (0, 1, 2, 3, 5, 20, 40)] + [(99, None)], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_index", "chunk", "previous", "next", "position").collect()))
    assert rows(C.chunk_with_neighbours(docs, 30, 10, 12)) == rows(C.with_neighbours(C.chunk(docs, 30, 10), 12)) != []


def references(t):
    out = [(x, f"[{x}]", "citation") for x in re.findall(r"\[([^\]]+)\]", t) if x.isdigit() or re.match(r"[A-Z][a-z]+\s+\d{4}", x)]
    return out + [(n, f"{k} {n}", "cross_reference") for k, n in re.findall(K.CROSS, t)]


def test_references_on_the_whole_small_table(spark):
    rows: dict = {}
    for r in sorted(registry.QUERIES["text_references"](spark, SF).collect(), key=lambda r: (r.p_partkey, r.at)):
        rows.setdefault(r.p_partkey, []).append((r.id, r.text, r.type))
    assert rows == {r.p_partkey: references(r.text) for r in scores._referring(spark, SF).collect()}


def test_quality_on_the_whole_small_table(spark):
    found = {r.doc_id: r.quality for r in registry.QUERIES["text_quality"](spark, SF).collect()}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        t = r["text"] or ""
        words, terms = len(t.split()), len(re.findall(K.TERMS, t))
        a = 0.15 * bool(re.search(K.HEADERS, t)) + 0.1 * bool(re.search(K.TABLES, t)) + 0.1 * bool(re.search(K.LISTED, t)) + 0.05 * bool(re.search(K.SOURCES, t))
        density = words / (len(t) / 100) if t else 0
        b = (0.15 if 3 <= density <= 20 else 0.08 if 2 <= density <= 25 else 0) + (0.15 if words >= 500 else 0.08 if words >= 200 else 0) + (0.1 if terms >= 10 else 0.05 if terms >= 5 else 0)
        n = r["n_chars"] // 500
        c = (0.1 if n >= 10 else 0.05 if n >= 5 else 0) + 0.05 * (r["source"] == "src1") + 0.05 * (r["lang"] == "en")
        assert found[r["doc_id"]] == pytest.approx(min(0.4, a) + min(0.4, b) + min(0.2, c))


def judged(section):
    score, label, reason = 0.0, "not_relevant", "Unable to parse response"
    for line in map(str.strip, section):
        if line.startswith("SCORE:"):
            try:
                score = max(0.0, min(1.0, float(line[6:])))
            except ValueError:
                score = 0.0
        elif line.startswith("LABEL:"):
            label = line[6:].strip().lower()
            label = label if label in ("highly_relevant", "somewhat_relevant") else "not_relevant"
        elif line.startswith("REASONING:"):
            reason = line[10:].strip()
    return score, label, reason


def judged_all(answer, n):
    sections = [s.strip().split("\n") for s in (answer or "").strip().split("Document ") if s.strip()]
    out = [(0.0, "not_relevant", "Incomplete response") if len(s) < 3 else judged(s[1:]) for s in sections]
    return (out + [(0.0, "not_relevant", "Missing response")] * n)[:n]


def test_judgements_on_the_whole_small_table(spark):
    found: dict = {}
    for r in sorted(registry.QUERIES["question_judged_all"](spark, SF).collect(), key=lambda r: (r.event_id, r.document)):
        found.setdefault(r.event_id, []).append((r.score, r.label, r.reason))
    assert found == {r.event_id: judged_all(r.answer, 4) for r in scores._judgements(spark, SF).collect()}


@pytest.mark.parametrize(("text", "want"), [("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05.5+0200", "2024-01-02 01:04:05.5"), ("2024-01-02", "2024-01-02 00:00:00"), ("20240102", None), ("", None), (None, None), ("12", None), ("2024-13-02T00:00:00", None)])
def test_times_in_any_zone(spark, text, want):
    from sparkloom.functions import times

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = spark.createDataFrame([(text,)], "t string").select(F.unix_micros(times.parsed("t")), F.unix_micros(times.parsed_or_epoch("t"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    micros = None if want is None else spark.sql(f"SELECT unix_micros(TIMESTAMP '{want}Z')").first()[0]
    assert tuple(row) == (micros, micros or 0)


def test_dictionary_tables(spark):
    from sparkloom.operators import dictionary as D

    rows = spark.createDataFrame([(1, 0, "the"), (1, 1, "cat"), (2, 0, "the"), (2, 1, "of"), (3, 0, "cat")], "query int, at int, word string")
    stop = spark.createDataFrame([("the",), ("of",), ("of",), (None,)], "word string")
    kept = D.without_stop_words(rows, stop)
    assert sorted(map(tuple, kept.collect())) == [(1, 1, "cat"), (2, 0, "the"), (3, 0, "cat")]
    words = spark.createDataFrame([("cat", "tom"), ("cat", "feline"), ("cat", "kitty"), ("cat", "tom"), (None, "x"), ("dog", "hound")], "term string, synonym string")
    found = {r.query: (r.words, r.expression) for r in D.with_synonyms(kept, words).collect()}
    assert found == {1: (["cat", "feline", "kitty"], "(cat OR feline OR kitty)"), 2: (["the"], "the"), 3: (["cat", "feline", "kitty"], "(cat OR feline OR kitty)")}
