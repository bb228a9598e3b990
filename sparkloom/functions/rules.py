"""Rules over questions, answers and log lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# --- Fixed values: patterns that decide ---
ACTION = r"(?i)执行|运行|帮我执行|直接执行|一键|下载并运行|run\s+this|execute|powershell|bash|shell|cmd"
DANGER = r"(?i)rm\s+-rf|del\s+/[sqf]|format\s+[a-z]:|shutdown\s+/s|invoke-expression|iex\s*\(|powershell\s+-enc|cmd\.exe|curl\s+[^\\n]*\|\s*(bash|sh)|wget\s+[^\\n]*\|\s*(bash|sh)|reg\s+add\b|bcdedit\b|vssadmin\s+delete\s+shadows"
INJECTION = r"(?i)ignore\s+(all\s+)?previous\s+instructions|reveal\s+system\s+prompt|you\s+are\s+now\s+developer|忽略(之前|以上|所有)?(系统|开发者)?指令|输出(系统|开发者)提示词|越狱提示词|绕过安全策略"
REFERENCE = r"这个|那个|上面|前面|如下|这里|它|他|她|该项|这个问题|那个问题"
POLICY_COMPLEX = r"\b(root cause|rca|postmortem|trade[- ]?off|architecture)\b|根因|复盘|多阶段|多步骤|全链路|架构设计|取舍|(对比|比较).{0,10}(并|和|与)|时间线|timeline|attack chain"
POLICY_MEDIUM = r"\b(how|why|compare|analyze)\b|如何|为什么|分析|解释|方案"
HINTS = r"(?i)对比|比较|trade[- ]?off|architecture|timeline|root cause|复盘|多阶段|attack chain"
REAL_TIME = r"(?i)\b(now|current|latest|today|real-time|live)\b|现在|当前|最新|实时|今天"
CLAIM_NEGATION = r"(?i)\bnot\b|\bno\b|\bnever\b|\bnone\b|\bneither\b|\bnor\b|没有|不是|未|无|非|不"
SPLIT_QUESTION = r"(?i)[，,。；;！？?!\n]|(?:\band\b|\bor\b|以及|并且|同时|还有)"
# --- end of fixed values ---


def blocked(c: str | Column) -> Column:
    """A dangerous command together with a wish to run it, or an attempt to override instructions."""
    t = T.text(c)
    return (t.rlike(DANGER) & t.rlike(ACTION)) | t.rlike(INJECTION)


def incomplete(c: str | Column) -> Column:
    """At most 12 characters, at most 24 with at most three words, or a pronoun that refers to something before."""
    t = T.text(c)
    n, words = F.length(t), F.size(T.matches(t, r"[\x{4e00}-\x{9fff}A-Za-z0-9_]+"))
    return (n <= 12) | ((n <= 24) & (words <= 3)) | t.rlike(REFERENCE)


def policy_level(c: str | Column) -> Column:
    """complex, medium or simple by cue words, then by 28 and 15 tokens."""
    t = F.lower(F.trim(T.text(c)))
    n = F.size(T.matches(t, T.SIMILARITY_TOKEN))
    return F.when(t == "", "simple").when(t.rlike(POLICY_COMPLEX), "complex").when(t.rlike(POLICY_MEDIUM), "medium").when(n >= 28, "complex").when(n >= 15, "medium").otherwise("simple")


def retrieval_sizes(c: str | Column, k: int = 6, n: int = 5, k_cap: int = 16, n_cap: int = 10) -> tuple[Column, Column]:
    """(top k, re-ranked n): 2 and 1 more for each of length, cue words and questions that apply, twice at most, up to the caps."""
    t = T.text(c)
    signs = (F.size(T.matches(t, T.SIMILARITY_TOKEN)) >= 28).cast("int") + t.rlike(HINTS).cast("int") + (F.length(t) - F.length(F.translate(t, "?？", "")) >= 2).cast("int")
    scale = F.least(F.lit(2), signs)
    return F.when(scale > 0, F.least(F.lit(k_cap), k + 2 * scale)).otherwise(k), F.when(scale > 0, F.least(F.lit(n_cap), n + scale)).otherwise(n)


def cache_seconds(c: str | Column, tier: Column, of_user: Column) -> Column:
    """0 for questions about the present; 180 for a user's own; else 300 fast, 60 deep, 120 otherwise."""
    low = F.lower(tier)
    return F.when(T.text(c).rlike(REAL_TIME), 0).when(of_user, 180).when(low == "fast", 300).when(low == "deep", 60).otherwise(120)


def audit_class(action: Column, result: Column) -> tuple[Column, Column]:
    a, r = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (action, result))
    category = F.when(a.startswith("auth."), "auth").when(a.startswith("query.") | a.startswith("document."), "data").when(a.startswith("admin."), "admin").when(a.startswith("prompt."), "prompt").otherwise("system")
    return category, F.when(r == "failed", "high").when(r == "denied", "medium").otherwise("info")


def grounding(detail: Column) -> Column:
    """The figure after grounding_support=, within 0 to 1; null without one."""
    found = F.nullif(F.regexp_extract(F.coalesce(detail, F.lit("")), r"grounding_support=([0-9]*\.?[0-9]+)", 1), F.lit(""))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found.try_cast("double")))


def parts(c: str | Column, most: int = 3) -> Column:
    """The first parts of a question of four characters or more, none of which is the whole."""
    q = F.trim(T.text(c))
    found = F.transform(F.split(q, SPLIT_QUESTION), lambda x: F.trim(x))
    return F.slice(F.filter(found, lambda x: (F.length(x) >= 4) & (F.lower(x) != F.lower(q))), 1, most)


def rewrites(c: str | Column) -> Column:
    """The question, its keywords, and some of them; none twice."""
    q, words = F.trim(T.text(c)), T.keywords(c)
    n = F.size(words)
    long_ = F.array_join(words, " ")
    short = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(2), F.least(F.lit(4), n - 1))), " ")
    more = F.when(n >= 2, F.filter(F.array(F.when(long_ != q, long_), F.when(F.lower(short) != F.lower(q), short)), lambda x: x.isNotNull() & (x != ""))).otherwise(F.array().cast("array<string>"))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(q), more)))


def claims(c: str | Column, least: int = 10) -> Column:
    """Claims of a text: sentences without their [citations], those, and the kind: date, number, negation or general."""

    def one(s: Column) -> Column:
        clean = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\[[^\]]+\]\s*", " "), r"\s+", " "))
        cited = F.filter(F.regexp_extract_all(s, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: x.rlike(r"^doc\w*:\w+"))
        kind = F.when(F.size(T.dates(clean)) > 0, "date").when(F.size(T.numbers(clean)) > 0, "number").when(clean.rlike(CLAIM_NEGATION), "negation").otherwise("general")
        return F.struct(clean.alias("text"), cited.alias("citations"), kind.alias("kind"))

    said = F.filter(F.transform(F.split(T.text(c), r"[.!?。！？]\s*"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.transform(said, one)


def compressed(sentences: Column, terms: Column, keep: float = 0.6, budget: int | Column = 400) -> Column:
    """The best share of sentences by query terms and position, in their order, until one doesn't fit the budget of characters."""
    n = F.size(sentences)

    def score(s: Column, i: Column) -> Column:
        held = F.size(F.array_intersect(F.array_distinct(T.tokens(s)), terms))
        place = F.when(i == 0, 0.3).when(i == n - 1, 0.2).otherwise(0.1)
        return F.struct((-(held / F.greatest(F.size(terms), F.lit(1)) + place)).alias("s"), i.alias("i"), s.alias("t"))

    best = F.slice(F.array_sort(F.transform(sentences, score)), F.lit(1), F.greatest(F.lit(1), F.floor(n * keep).cast("int")))
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        over = a["full"] | (a["used"] + F.length(x["t"]) > budget)
        return F.struct(F.when(over, a["out"]).when(a["out"] == "", x["t"]).otherwise(F.concat(a["out"], F.lit(" "), x["t"])).alias("out"), F.when(over, a["used"]).otherwise(a["used"] + F.length(x["t"])).alias("used"), over.alias("full"))

    return F.when(n > 0, F.aggregate(ordered, state, step, lambda a: a["out"])).otherwise("")


def compressed_in_turn(docs: Column, terms: Column, keep: float = 0.6, budget: int = 400) -> Column:
    """Of a query's documents (doc, sentences) in the order of rank: (doc, text) of those of which the shared budget leaves something."""
    none = F.array().cast("array<struct<doc:bigint,text:string>>")

    def step(a: Column, x: Column) -> Column:
        text = F.when(a["used"] < budget, compressed(x["sentences"], terms, keep, budget - a["used"])).otherwise("")
        kept = F.when(F.length(text) > 0, F.concat(a["done"], F.array(F.struct(x["doc"].alias("doc"), text.alias("text"))))).otherwise(a["done"])
        return F.struct(kept.alias("done"), (a["used"] + F.length(text)).alias("used"))

    return F.aggregate(docs, F.struct(none.alias("done"), F.lit(0).alias("used")), step, lambda a: a["done"])
