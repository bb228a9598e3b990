"""Text functions as column expressions: tokenisers, language, redaction, extraction, similarity. A null text counts as ''."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns and word lists that results depend on ---
CJK = r"[\x{4e00}-\x{9fff}]"
BM25_TOKEN = r"[A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]"
REWRITE_TOKEN = r"[A-Za-z0-9_\-]{2,}|[\x{4e00}-\x{9fff}]{2,}"
GRAPH_TOKEN = r"[A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]{2,}"
SIMILARITY_TOKEN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
EMBEDDING_TOKEN = r"[A-Za-z0-9_\-]{2,}|[\x{4e00}-\x{9fff}]"
REWRITE_STOP_WORDS = ["the", "is", "are", "a", "an", "to", "of", "in", "on", "for", "and", "or", "请问", "帮我", "一下", "这个", "那个"]
SECRETS = [
    r"sk-[A-Za-z0-9]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN (?:RSA|EC|OPENSSH|PRIVATE) KEY-----",
    r"(?i)\b(?:password|passwd|token|secret)\s*[:=]\s*\S{4,}",
]
DATES = [
    r"\b(?:19|20)\d{2}\b",
    r"\d{4}年(?:\d{1,2}月)?(?:\d{1,2}日)?",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"(?i)Q[1-4]\s*\d{4}",
]
NUMBER = r"(?i)\$?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|thousand|[MBK]|%))?"
PAGE_LINE = r"(?i)^(?:Page\s+\d+|第\s*\d+\s*页|-\s*\d+\s*-|\d+\s*/\s*\d+|\[\s*\d+\s*\])\s*$"
ABBREVIATIONS = ["dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "e.g.", "i.e.", "etc.", "vs.", "inc.", "ltd.", "corp.", "fig.", "vol.", "no.", "p.", "pp.", "ed."]
HEDGES = ["可能", "或许", "大概率", "根据现有信息", "目前无法确认", "insufficient evidence", "likely"]
RELATIONS = [
    ("DEPENDS_ON", ["depend", "依赖", "based on", "基于"]),
    ("INCLUDES", ["include", "包括", "contains", "包含"]),
    ("USES", ["use", "使用", "调用"]),
    ("STORES_IN", ["store", "存储", "写入"]),
]
AGENT_CLASSES = [
    ("pdf_text", r"\bpdf\b|pdf提取|提取pdf|读取pdf|pdf文字|pdf文本|ocr|图片|图像|照片|截图|\bimage\b"),
    ("artificial_intelligence", r"人工智能|\bai\b|机器学习|深度学习|大模型|\bllm\b|神经网络|rag|提示词|prompt"),
    ("cybersecurity", r"网络安全|攻防|漏洞|入侵|攻击|防护|加固|应急|溯源|病毒|木马|勒索|cve|sql注入|xss|横向移动|权限提升|c2|mitre|att&ck|soc|siem|edr"),
]
# --- end of fixed values ---


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it; inside a function of array items, once and not per item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: str | Column, pattern: str) -> Column:
    """All matches of a pattern, whole."""
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def tokens(c: str | Column, pattern: str = BM25_TOKEN) -> Column:
    return matches(F.lower(text(c)), pattern)


def keywords(c: str | Column, limit: int = 8) -> Column:
    """The first distinct tokens that aren't stop words."""
    return F.slice(F.filter(F.array_distinct(tokens(c, REWRITE_TOKEN)), lambda x: ~x.isin(REWRITE_STOP_WORDS)), 1, limit)


def count_matches(c: str | Column, char_class: str) -> Column:
    """How many characters belong to a class, given without brackets."""
    return F.length(F.regexp_replace(text(c), f"[^{char_class}]", ""))


def language(c: str | Column, threshold: float = 0.20) -> Column:
    """zh where over `threshold` of letters, digits and ideographs are ideographs, or where there are none; else en."""
    han, all_ = count_matches(c, r"\x{4e00}-\x{9fff}"), count_matches(c, r"a-zA-Z0-9\x{4e00}-\x{9fff}")
    return F.when((all_ == 0) | (han > threshold * all_), "zh").otherwise("en")


def language_mix(c: str | Column) -> Column:
    """chinese, english, mixed or unknown by the share of ideographs among ideographs and Latin letters."""
    han, latin = count_matches(c, r"\x{4e00}-\x{9fff}"), count_matches(c, "a-zA-Z")
    share = han / (han + latin)
    return F.when(han + latin == 0, "unknown").when(share > 0.7, "chinese").when(share < 0.3, "english").otherwise("mixed")


def redacted(c: str | Column) -> tuple[Column, Column]:
    """(text with secrets replaced, number of replacements). Patterns apply one after the other."""
    out, n = text(c), F.lit(0)
    for p in SECRETS:
        n = n + F.size(matches(out, p))
        out = F.regexp_replace(out, p, "[REDACTED]")
    return out, n


def dates(c: str | Column) -> Column:
    """Distinct date strings, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[matches(c, p) for p in DATES]))))


def numbers(c: str | Column) -> Column:
    """Numbers with their unit applied, in order; a percentage keeps its figure."""

    def value(m: Column) -> Column:
        plain = F.regexp_replace(m, r"[A-Za-z,$%\s]", "").try_cast("double")
        low = F.lower(m)
        unit = (
            F.when(m.contains("%"), 1.0)
            .when(low.contains("billion") | m.contains("B"), 1e9)
            .when(low.contains("million") | m.contains("M"), 1e6)
            .when(low.contains("thousand") | m.contains("K"), 1e3)
            .otherwise(1.0)
        )
        return plain * unit

    return F.filter(F.transform(matches(c, NUMBER), value), lambda x: x.isNotNull())


def without_page_lines(c: str | Column) -> Column:
    """The text without lines that are page numbers."""
    return F.array_join(F.filter(F.split(text(c), "\n"), lambda x: ~F.trim(x).rlike(PAGE_LINE)), "\n")


def sentences(c: str | Column) -> Column:
    """Sentences of three characters or more; full stops of abbreviations don't end one; the whole text where there is none."""
    raw = F.trim(text(c))
    held = raw
    for a in ABBREVIATIONS:
        held = F.replace(held, F.lit(a), F.lit(a.replace(".", "<ABBR>")))
        held = F.replace(held, F.lit(a.upper()), F.lit(a.upper().replace(".", "<ABBR>")))
    parts = F.transform(F.regexp_extract_all(held, F.lit("[^。！？.!?]+[。！？.!?]?"), F.lit(0)), lambda x: F.trim(F.replace(x, F.lit("<ABBR>"), F.lit("."))))
    found = F.filter(parts, lambda x: F.length(x) >= 3)
    return F.when(raw == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(raw)).otherwise(found)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets; one empty: 0; both empty: `both_empty`."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def support(sentence: Column, evidence: Column) -> Column:
    """Share of a sentence's distinct tokens that the evidence tokens hold; 0 where either is empty."""
    s = F.array_distinct(tokens(sentence, SIMILARITY_TOKEN))
    return F.when((F.size(s) == 0) | (F.size(evidence) == 0), 0.0).otherwise(F.size(F.array_intersect(s, evidence)) / F.greatest(F.size(s), F.lit(1)))


def hedged(c: str | Column) -> Column:
    low = F.lower(text(c))
    out = F.lit(False)
    for h in HEDGES:
        out = out | low.contains(h)
    return out


def relation(c: str | Column) -> Column:
    """The first relation that a word of the text suggests."""
    low = F.lower(text(c))
    out = None
    for name, words in RELATIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("RELATED_TO")


def agent_class(c: str | Column) -> Column:
    low = F.lower(F.trim(text(c)))
    out = F.when(low == "", "general")
    for name, pattern in AGENT_CLASSES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("general")


def pii(c: str | Column) -> dict[str, Column]:
    """Whether a text holds an e-mail address, a phone number, a social security number, a card number."""
    return {
        "email": text(c).rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
        "phone": text(c).rlike(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
        "ssn": text(c).rlike(r"\b\d{3}-\d{2}-\d{4}\b"),
        "card": text(c).rlike(r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    }


def ocr_score(c: str | Column) -> Column:
    """Length, letters and digits once more, ideographs twice more."""
    return F.length(text(c)) + count_matches(c, r"a-zA-Z0-9\x{4e00}-\x{9fff}") + 2 * count_matches(c, r"\x{4e00}-\x{9fff}")


def retrieval_complexity(c: str | Column, complex_words: str = r"(?i)compare|versus|difference|relationship|impact|analyze|evaluate|对比|比较|区别|关系|影响|分析", medium_words: str = r"(?i)\bhow\b|explain|describe|why|如何|怎么|解释|为什么") -> Column:
    """simple, medium or complex by length, cue words and question marks; two ideographs count as a word."""
    t = F.trim(text(c))
    n = F.size(matches(t, r"\b[a-zA-Z0-9_]+\b")) + F.floor(count_matches(t, r"\x{4e00}-\x{9fff}") / 2)
    marks = F.length(t) - F.length(F.translate(t, "?？", ""))
    return F.when(t == "", "simple").when(t.rlike(complex_words) | (marks >= 2) | (n > 20), "complex").when(t.rlike(medium_words) | (n >= 10), "medium").otherwise("simple")
