"""Additive scores of questions, answers, claims, retrieved chunks and relations. Column expressions; a null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.cascade import NEGATION
from sparkloom.operators.verification import unmatched_numbers

# --- Fixed values: words and patterns that decide, weights ---
QUESTION_WORDS = "what how why when where who which can could would should does do is are 什么 如何 为什么 怎么 哪里 谁 哪个 怎样 为何 何时 何地 是否 能否".split()
CONNECTORS = ["and", "or", "also", "as well as", "in addition", "furthermore", "moreover", "besides", "plus", "和", "与", "以及", "还有", "另外", "并且", "同时", "而且"]
INDICATORS = [
    (1.5, ["compare", "difference", "versus", "vs", "比较", "对比", "区别", "trade-off", "trade off"]),
    (0.5, ["step", "process", "how to", "procedure", "步骤", "流程", "过程", "阶段", "stage", "phase"]),
    (1.0, ["analyze", "explain", "why", "reason", "因为", "原因", "分析", "解释", "详细", "detail"]),
    (0.5, ["all", "every", "list", "summarize", "总结", "列出", "所有"]),
]
SPLITS = [
    ("comparison", ["区别", "对比", "比较", "difference", "compare", "versus", "vs"]),
    ("sequential", ["步骤", "如何", "怎么", "流程", "how to", "steps", "process"]),
    ("parallel", ["和", "与", "以及", "还有", "另外", "and", "also", "as well as"]),
]
FORCE_WEB = [
    r"(上网|联网|网络|互联网|网页|web|google|bing).{0,6}(查|搜索|检索|看看|找)",
    r"(查|搜索|检索|找).{0,6}(上网|联网|网络|互联网|网页|web|google|bing)",
    r"(请|帮我|麻烦).{0,6}(上网|联网).{0,6}(查|搜)",
]
FRESH = [r"(最新|近期|最近|今天|今日|刚刚|实时|当下|本周|本月|今年)", r"(breaking|today|latest|recent|real[- ]?time)"]
AUGMENTED = ["[补全提示]", "[仅聚焦以下文档文件:"]
CASUAL = [
    r"^(你好|您好|hi|hello|hey|哈喽|在吗|早上好|中午好|晚上好)(啊|呀|哦|呢)?[!！,.。?？ ]*$",
    r"^(谢谢|感谢|thx|thanks)[!！,.。?？ ]*$",
    r"(你是谁|你能做什么|介绍一下你自己|自我介绍)",
    r"(你在干嘛|你在做什么|你忙吗|最近怎么样|你还在吗|陪我聊聊|聊会天)",
    r"^(嗯|哦|啊|呀|诶|哈哈|嘿嘿|晚安|早安|拜拜|再见)[!！,.。?？ ]*$",
    r"(随便聊聊|聊聊天|闲聊|smalltalk|casual chat)",
]
TASK = [
    r"(请|帮我|需要|如何|怎么|怎样|给出|给我|分析|总结|解释|比较|编写|生成|优化|排查|修复|调试|实现|介绍|讲解|说明|列举|列出|展示|提供)",
    r"(what|how|why|analyze|summarize|explain|compare|debug|implement|fix|introduce|describe|list|show|provide)",
]
FACT = [
    r"(是什么|是谁|多少|几点|哪里|哪家|哪种|哪一个|何时|什么时候|多久|多大|多高|多少岁|有哪些|有什么|包含|涵盖)",
    r"(价格|股价|汇率|天气|新闻|公告|财报|比分|赛程|票房|发布|更新|版本|漏洞|趋势|动态|情报|威胁|知识|文档|资料|内容)",
    r"(what is|who is|how much|when is|where is|price|weather|news|release|update|version|score|knowledge|document|content)",
]
NOISY = "related 关联 相关 link links linked_to unknown 其他 other misc general 通用 associated connected".split()
STRONG = (
    "causes 导致 leads_to 引起 results_in 产生 depends 依赖 requires 需要 relies_on 基于 uses 利用 employs 采用 applies 应用 targets 攻击 affects 影响 "
    "impacts 作用于 mitigates 缓解 prevents 防止 protects 保护 implements 实现 contains 包含 provides 提供 produces generates 生成 creates 创建 "
    "improves 改进 enhances 增强 optimizes 优化"
).split()
FILLERS = ["不知道", "无法回答", "没有信息", "don't know", "cannot answer", "no information"]
SPANS = [r"\d+\.?\d*%?", r"\d{4}[年\-/]\d{1,2}[月\-/]?\d{0,2}日?", r"\d{1,2}/\d{1,2}/\d{2,4}", r"[\x{4e00}-\x{9fff}]{2,}", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"]
STOP = "a an the is are was were in on at to for of and or".split()
CUT_OFF = ["...", "…", "[truncated]", "[...]"]
# --- end of fixed values ---

HAN = r"[\x{4e00}-\x{9fff}]"


def _holds(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _matches(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("(?iU)" + p)
    return out


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def complexity(c: str | Column) -> tuple[Column, Column]:
    """(score, level): length, question words, connectors, question marks and cue words added up; simple to 2, medium to 5, else complex."""
    t = T.text(c)
    low, n = F.lower(t), F.length(t)
    asked = F.size(F.filter(F.split(F.trim(low), r"(?U)\s+"), lambda w: w.isin(QUESTION_WORDS)))
    joined = sum(low.contains(w).cast("int") for w in CONNECTORS)
    bonus = sum(F.when(_holds(low, words), weight).otherwise(0.0) for weight, words in INDICATORS)
    score = (
        F.when(n < 15, 0.0).when(n < 40, 1.0).when(n < 80, 2.0).otherwise(3.0)
        + F.when(asked == 0, 0.5).when(asked == 1, 0.0).when(asked == 2, 1.0).otherwise(2.0)
        + F.when(joined >= 3, 2.0).when(joined >= 1, 1.0).otherwise(0.0)
        + F.when(_count(t, "?") + _count(t, "？") > 1, 1.0).otherwise(0.0)
        + F.least(F.lit(3.0), bonus)
    )
    return score, F.when(score <= 2, "simple").when(score <= 5, "medium").otherwise("complex")


def decomposition(c: str | Column) -> tuple[Column, Column]:
    """(whether a question should be taken apart, how: comparison, sequential, parallel or general)."""
    t = T.text(c)
    both = _holds(t, ["和", "与"]) & _holds(t, SPLITS[0][1][:5])
    several = _holds(t, ["以及", "还有", "另外", "and also", "as well as"])
    steps = _holds(t, SPLITS[1][1]) & (F.length(t) > 30)
    needed = both | several | (F.length(t) > 50) | (_count(t, "?") > 1) | (_count(t, "？") > 1) | steps
    how = F.coalesce(*[F.when(_holds(t, words), name) for name, words in SPLITS], F.lit("general"))
    return needed, how


def _asked(c: str | Column) -> Column:
    """A question in lower case without what a service has put behind it."""
    t = T.text(c)
    for mark in AUGMENTED:
        t = F.when(t.contains(mark), F.substring_index(t, mark, 1)).otherwise(t)
    return F.lower(F.trim(t))


def _wants_facts(t: Column) -> Column:
    return (t != "") & (_matches(t, TASK) | _matches(t, FACT) | _holds(t, ["?", "？"]))


def needs_web(c: str | Column) -> Column:
    """A question that names the web, or asks for facts and for something recent and isn't small talk."""
    t = _asked(c)
    return (t != "") & (_matches(t, FORCE_WEB) | (_matches(t, FRESH) & ~_matches(t, CASUAL) & _wants_facts(t)))


def small_talk(c: str | Column) -> Column:
    """Greetings and thanks, or up to twelve words to or of a person, without a task or a question."""
    t = _asked(c)
    n = F.size(T.matches(t, r"[A-Za-z0-9_]+|" + HAN))
    person = (n > 0) & (n <= 12) & _holds(t, ["你", "我", "咱们", "我们"]) & ~_wants_facts(t)
    return (t != "") & ~needs_web(c) & ~_matches(t, TASK) & (_matches(t, CASUAL) | person)


def answer_quality(c: str | Column) -> Column:
    """0.8, less for under 100 or over 2,000 characters, a single sentence, or saying that nothing is known."""
    t = T.text(c)
    n = F.length(t)
    score = 0.8 - F.when(n < 100, 0.2).when(n > 2000, 0.1).otherwise(0.0) - F.when(F.size(F.split(t, "[。！？.!?]", -1)) < 2, 0.1).otherwise(0.0) - F.when(_holds(F.lower(t), FILLERS), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def factual_spans(c: str | Column, most: int = 5) -> Column:
    """The first distinct numbers, dates and names, kind by kind."""
    return F.slice(F.array_distinct(F.concat(*[T.matches(c, "(?U)" + p) for p in SPANS])), 1, most)


def claim_support(claim: Column, cited: Column, has_citation: Column, tolerance: float = 0.15) -> Column:
    """How well the cited text bears a claim, 0 to 1 (supported from 0.6): 0.3 without citation, 0.2 where it leads to no text; else 0.5 and
    more for numbers and dates that agree and shared words, less for those that don't and for a negation on one side only."""
    c, s = T.text(claim), T.text(cited)
    numbers, known = T.numbers(c), T.numbers(s)
    dates, dated = T.dates(c), T.dates(s)
    same_numbers = F.when(F.size(known) > 0, F.size(unmatched_numbers(numbers, known, tolerance)) == 0).otherwise(False)
    same_dates = F.arrays_overlap(dates, dated)
    words, there = (F.array_distinct(F.concat(T.matches(F.lower(x), r"(?U)\b[a-z]{4,}\b"), T.matches(x, HAN + "{2,}"))) for x in (c, s))
    overlap = F.when(F.size(words) > 0, F.size(F.array_intersect(words, there)) / F.greatest(F.size(words), F.lit(1))).otherwise(0.0)
    score = (
        0.5
        + F.when(F.size(numbers) == 0, 0.0).when(same_numbers, 0.25).otherwise(-0.5)
        + F.when(F.size(dates) == 0, 0.0).when(same_dates, 0.25).otherwise(-0.5)
        + F.when(overlap > 0.5, 0.25).when(overlap > 0.3, 0.15).when(overlap > 0.15, 0.05).otherwise(0.0)
        - F.when(c.rlike(NEGATION) != F.lower(s).rlike(NEGATION), 0.3).otherwise(0.0)
    )
    return F.when(~has_citation, 0.3).when(s == "", 0.2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def query_keywords(c: str | Column) -> Column:
    """Words of over two letters without stop words; of a question with ideographs all its characters, pairs and triples, each once."""
    t = T.text(c)
    plain = F.filter(T.matches(F.lower(t), r"(?U)\b\w+\b"), lambda w: ~w.isin(STOP) & (F.length(w) > 2))
    bare = F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}a-zA-Z0-9]", "")
    runs = [_runs(bare, k) for k in (1, 2, 3)]
    return F.when(t.rlike(HAN), F.array_distinct(F.concat(*runs))).otherwise(plain)


def _runs(c: Column, k: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1)))
    return F.when(F.length(c) >= k, F.transform(places, lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def retrieval_quality(queries: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """(query, coverage, relevance, diversity, completeness, overall) of what was retrieved for each query.

    `queries` has query and text, `chunks` query, content, score and source (null scores count 0.5, null sources as unknown). Coverage is
    the share of the query's keywords in any chunk (0.5 without keywords), relevance the mean of the `top` scores, diversity the share of
    different sources, completeness from the mean length less a fifth of the share that is cut off. A query without chunks has zeros.
    """
    asked = queries.select("query", F.transform(query_keywords("text"), F.lower).alias("keys"), (T.text("text") != "").alias("said"))
    rows = chunks.select("query", T.text("content").alias("content"), F.coalesce("score", F.lit(0.5)).cast("double").alias("score"), F.coalesce("source", F.lit("unknown")).alias("source")).join(asked, "query")
    low = F.lower("content")
    held = F.filter(F.array_distinct("keys"), lambda k: low.contains(k))
    ranked = rows.withColumns({"held": held, "cut": _holds(F.col("content"), CUT_OFF)})
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, top)
    found = ranked.groupBy("query").agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), best.alias("best"), F.count("*").alias("n"), F.count_distinct("source").alias("sources"),
        F.avg(F.length("content")).alias("length"), F.count_if("cut").alias("cut"),
    )
    m = asked.join(found, "query", "left")
    covered = F.size(F.filter("keys", lambda k: F.array_contains(F.col("held"), k)))
    coverage = F.when(F.col("n").isNull() | ~F.col("said"), 0.0).when(F.size("keys") == 0, 0.5).otherwise(covered / F.greatest(F.size("keys"), F.lit(1)))
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("best"), F.lit(1))
    share = F.col("sources") / F.col("n")
    length = F.col("length")
    whole = F.when(length >= 300, 1.0).when(length >= 150, 0.6 + (length - 150) / 150 * 0.4).when(length >= 50, 0.3 + (length - 50) / 100 * 0.3).otherwise(length / 50 * 0.3)
    parts = {
        "coverage": coverage, "relevance": F.when(F.col("best").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))),
        "diversity": F.when(share >= 0.8, share).when(share >= 0.5, share * 0.9).otherwise(share * 0.7),
        "completeness": F.when(F.col("n") > 0, F.greatest(F.lit(0.0), whole - F.col("cut") / F.col("n") * 0.2)),
    }
    scored = m.select("query", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in parts.items()])
    overall = 0.30 * F.col("coverage") + 0.40 * F.col("relevance") + 0.15 * F.col("diversity") + 0.15 * F.col("completeness")
    return scored.withColumn("overall", overall)


def relation_weight(relation: str | Column, quality: Column, noisy: list[str] | None = None, strong: list[str] | None = None) -> Column:
    """0 for no or a noisy relation, 1 where it holds a strong word, else 0.6; up to 30 % more by the quality of its document (all of it from 0.7 on), 1 at most."""
    r = F.lower(F.trim(T.text(relation)))
    base = F.when((r == "") | r.isin(NOISY if noisy is None else noisy), 0.0).when(_holds(r, STRONG if strong is None else strong), 1.0).otherwise(0.6)
    return F.least(F.lit(1.0), base * (1.0 + F.when(quality >= 0.7, 0.3).otherwise(quality * 0.3)))


def name_relevance(tokens: Column, name: Column) -> Column:
    """Query tokens in a name, exact ones 1 and parts of one another 0.5 for each pair, over the longer of both; 1 at most."""
    own = F.array_distinct(T.tokens(name, T.GRAPH_TOKEN))
    exact = F.size(F.filter(tokens, lambda t: F.array_contains(own, t)))
    near = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + 0.5 * F.size(F.filter(own, lambda e: e.contains(t) | t.contains(e))))
    n = F.greatest(F.size(tokens), F.size(own), F.lit(1))
    return F.when((F.size(tokens) == 0) | (F.size(own) == 0), 0.0).otherwise(F.least(F.lit(1.0), (exact + near) / n))


def graph_signal(entities: Column, relevance: Column, neighbours: Column, neighbour_weight: Column, paths: Column, path_weight: Column, quality: Column) -> tuple[Column, Column]:
    """(score, confidence) from the numbers of entities, neighbours and paths found and their mean relevance or weight (null where there are none)."""
    e = (F.least(F.lit(1.0), entities / 5) + F.coalesce(relevance, F.lit(0.0))) / 2.0
    near, far = F.coalesce(neighbour_weight, F.lit(0.0)), F.coalesce(path_weight, F.lit(0.0))
    n = F.when(quality >= 0.7, F.least(F.lit(1.0), near * 1.15)).otherwise(near)
    p = F.least(F.lit(1.0), far * 1.2)
    there = [(entities > 0, 0.35, e), (neighbours > 0, 0.40, n), (paths > 0, 0.25, p)]
    total = sum(F.when(has, w).otherwise(0.0) for has, w, _ in there)
    score = sum(F.when(has, w * c).otherwise(0.0) for has, w, c in there) / F.nullif(total, F.lit(0.0)) * (0.9 + quality * 0.1)
    score = F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))
    high = (score >= 0.7) & (entities >= 3) & ((neighbours >= 5) | (paths >= 3))
    return score, F.when(high, "high").when((score >= 0.5) | ((entities >= 2) & (neighbours >= 3)), "medium").otherwise("low")
