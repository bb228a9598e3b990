"""Types, keywords, entities and importance of chunks, references in a text, and the quality of a document's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.references import trimmed

# --- Fixed values: signs of a type in the order in which types are tried, words that are no keywords, weights ---
CODE_WORDS = ["def ", "class ", "import ", "function", "var ", "const ", "let ", "return", "if (", "for ("]
CODE_SIGNS = ["{", "}", "(", ")", ";", "=>", "->"]
LISTS = [r"^\s*(\d+\.|\d+\)|\(\d+\))", r"^\s*[-*•·]", r"^\s*[a-z]\)"]
QUOTES = ["according to", "as stated", "引用", "如下所述", "根据"]
DEFINITIONS = [r"^[A-Z][A-Za-z\s]+(?:is|means|refers to|defined as)", r"^[一-龥]+[：:]\s*.+", r"^[一-龥]+是指", r"^[一-龥]+指的是"]
STEPS = [r"(?:step|步骤)\s*\d+", r"第[一二三四五六七八九十]+步", r"^\d+\.\s+\w+"]
ORDER_WORDS = ["首先", "然后", "接下来", "最后", "finally", "next", "after that"]
METADATA = [r"(?:author|date|version|status|category|tag|keyword)s?:", r"(?:作者|日期|版本|状态|分类|标签|关键词)[：:]"]
NO_KEYWORDS = "the a an and or but in on at to for of with by 是 的 了 在 有 和 与 及 等 中 将 可以 进行".split()
ENTITIES = {
    "acronyms": r"\b[A-Z]{2,10}\b",
    "numbers": r"\b\d+(?:\.\d+)*\b",
    "ip_addresses": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[^\s]+",
}
MOST = {"acronyms": 5, "numbers": 5, "urls": 3}
WEIGHTS = {"heading": 0.9, "definition": 0.8, "procedure": 0.8, "table": 0.7, "code": 0.6, "list": 0.6, "quote": 0.5, "paragraph": 0.5, "metadata": 0.3}
CROSS = r"(?i)(Chapter|Section|Figure|Table)\s+(\d+\.?\d*)"
HEADERS = r"(?m)^#+\s+.+$|^\d+\.\s+[A-Z][^.]+$"
TABLES = r"\|.+\|.+\||\t.+\t.+\t"
LISTED = r"(?m)^[-*•]\s+.+$|^\d+\.\s+.+$"
SOURCES = r"(?i)(references?|bibliography|citations?|参考文献)"
TERMS = r"(?i)\b(?:AI|ML|API|system|process|data|algorithm|model|method|approach|analysis|implementation|framework|architecture|optimization)\b"
# --- end of fixed values ---


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _count(c: Column, sign: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))) / len(sign)).cast("int")


def _matching(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("(?U)" + p)
    return out


def kind(c: str | Column) -> Column:
    """heading, code, table, list, quote, definition, procedure, metadata or paragraph: the first whose signs a chunk has. An empty one is a paragraph."""
    t = T.text(c)
    low, own = F.lower(t), trimmed(t)
    lines, said = F.split(t, "\n"), F.split(own, "\n")
    end = F.right(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(1))
    upper = F.left(t, F.lit(1)).rlike(r"\p{IsUppercase}")
    heading = ((F.length(t) < 100) & ~end.isin(".", "。", "!", "！", "?", "？") & (upper | t.rlike("[第一二三四五六七八九十]"))) | t.startswith("#")
    words, signs = sum(t.contains(w).cast("int") for w in CODE_WORDS), sum(_count(t, s) for s in CODE_SIGNS)
    code = t.startswith("```") | t.startswith("    ") | (words >= 2) | (signs >= 5)
    table = ((_count(t, "|") >= 4) & (F.size(lines) >= 2) & F.forall(F.slice(lines, 1, 3), lambda x: x.contains("|"))) | _any(low, ["<table", "<tr>"])
    listed = F.lit(False)
    for p in LISTS:
        listed = listed | (F.size(_lines_like(said, p)) >= 2)
    quote = t.startswith(">") | t.startswith("「") | t.startswith("“") | _any(low, QUOTES)
    definition = _matching(own, DEFINITIONS) | low.contains("(acronym)") | _any(t, ["缩写", "全称"])
    procedure = _matching(low, STEPS) | (sum(low.contains(w).cast("int") for w in ORDER_WORDS) >= 2)
    named = [(heading, "heading"), (code, "code"), (table, "table"), ((F.size(said) >= 2) & listed, "list"), (quote, "quote"), (definition, "definition"), (procedure, "procedure"), (_matching(low, METADATA), "metadata")]
    out = F.when(t == "", "paragraph")
    for has, name in named:
        out = out.when(has, name)
    return out.otherwise("paragraph")


def _lines_like(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: x.rlike("(?U)" + pattern))


def entities(c: str | Column) -> dict[str, Column]:
    """Distinct acronyms, numbers, addresses and links in the order of the text, some of them limited in number."""
    found = {n: F.array_distinct(T.matches(c, "(?U)" + p)) for n, p in ENTITIES.items()}
    return {n: F.slice(x, 1, MOST[n]) if n in MOST else x for n, x in found.items()}


def enriched(chunks: DataFrame, key: list[str], text: str = "chunk", most: int = 10) -> DataFrame:
    """`chunks` with type, length, word_count, keywords (the most frequent words of over three letters; of equal counts the first in the
    text), entities found, has_question, has_code, has_url, has_email and importance. `key` tells chunks apart, of which each is told where it
    lies; `position` (start, middle or end) is used where there is one."""
    t = T.text(text)
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "), r"(?U)[\s\x1c-\x1f]+"), lambda w: (F.length(w) > 3) & ~w.isin(NO_KEYWORDS))
    # equal words stand together in the order of the words; a run of them is a word, its length and its first place
    rows = chunks.withColumn("_sorted", F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))))
    begins = lambda x, i: F.when((i == 0) | (F.get("_sorted", i - 1)["word"] != x["word"]), i)
    rows = rows.withColumn("_runs", F.filter(F.transform("_sorted", begins), lambda i: i.isNotNull()))
    ends = lambda k: F.coalesce(F.get("_runs", k + 1), F.size("_sorted"))
    counts = F.transform("_runs", lambda i, k: F.struct((i - ends(k)).alias("_minus"), F.get("_sorted", i)["at"].alias("_first"), F.get("_sorted", i)["word"].alias("_word")))
    rows = rows.withColumn("_top", F.slice(F.array_sort(counts), 1, most))
    said = F.filter(F.split(trimmed(t), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    rows = rows.withColumns(
        {
            "type": kind(text), "length": F.length(t), "word_count": F.size(said), "keywords": F.transform("_top", lambda x: x["_word"]),
            "entities": F.struct(*[x.alias(n) for n, x in entities(text).items()]), "has_question": _any(t, ["?", "？"]), "has_code": _any(t, ["```", "def ", "class ", "function"]),
            "has_url": _any(t, ["http://", "https://"]), "has_email": t.contains("@") & t.contains("."),
        }
    ).drop("_top", "_runs", "_sorted")
    position = F.col("position") if "position" in chunks.columns else F.lit("middle")
    return rows.withColumn("importance", importance(position))


def importance(position: Column) -> Column:
    """0 to 1 from the columns that `enriched` adds: the type's weight, more at the start or end, for a good length, code, keywords and entities."""
    base = F.lit(0.5)
    for name, w in WEIGHTS.items():
        base = F.when(F.col("type") == name, w).otherwise(base)
    n = F.col("length")
    some = F.lit(False)
    for name in ENTITIES:
        some = some | (F.size(F.col("entities")[name]) > 0)
    score = (
        base
        + F.when(position == "start", 0.1).when(position == "end", 0.05).otherwise(0.0)
        + F.when(n < 50, -0.1).when(n > 2000, -0.05).when(n.between(200, 800), 0.05).otherwise(0.0)
        + F.when(F.col("has_code"), 0.05).otherwise(0.0)
        + F.when(F.size("keywords") >= 3, 0.05).otherwise(0.0)
        + F.when(some, 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def references(c: str | Column) -> Column:
    """(id, text, type): [citations] that are a number or a name and year, then chapters, sections, figures and tables that are named."""
    t = T.text(c)
    cited = F.filter(F.regexp_extract_all(t, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: x.rlike(r"(?U)^\d+$|^[A-Z][a-z]+\s+\d{4}"))
    one = F.transform(cited, lambda x: F.struct(x.alias("id"), F.concat(F.lit("["), x, F.lit("]")).alias("text"), F.lit("citation").alias("type")))
    kinds, numbers = (F.regexp_extract_all(t, F.lit("(?U)" + CROSS), F.lit(i)) for i in (1, 2))
    two = F.zip_with(kinds, numbers, lambda a, b: F.struct(b.alias("id"), F.concat(a, F.lit(" "), b).alias("text"), F.lit("cross_reference").alias("type")))
    return F.concat(one, two)


def document_quality(c: str | Column, pages: Column, markdown: Column, converted: Column) -> Column:
    """0 to 1: up to 0.4 each for structure (headings, tables, lists, references) and content (words to characters, length, terms), 0.2 for
    pages, format and converter."""
    t = T.text(c)
    structure = sum(F.when(t.rlike(p), w).otherwise(0.0) for p, w in ((HEADERS, 0.15), (TABLES, 0.10), (LISTED, 0.10), (SOURCES, 0.05)))
    words = F.size(F.filter(F.split(trimmed(t), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    density = words / (F.greatest(F.length(t), F.lit(1)) / 100)
    terms = F.size(T.matches(t, "(?U)" + TERMS))
    content = (
        F.when(F.length(t) == 0, 0.0).when(density.between(3, 20), 0.15).when(density.between(2, 25), 0.08).otherwise(0.0)
        + F.when(words >= 500, 0.15).when(words >= 200, 0.08).otherwise(0.0)
        + F.when(terms >= 10, 0.10).when(terms >= 5, 0.05).otherwise(0.0)
    )
    about = F.when(pages >= 10, 0.10).when(pages >= 5, 0.05).otherwise(0.0) + F.when(markdown, 0.05).otherwise(0.0) + F.when(converted, 0.05).otherwise(0.0)
    return F.least(F.lit(0.4), structure) + F.least(F.lit(0.4), content) + F.least(F.lit(0.2), about)
