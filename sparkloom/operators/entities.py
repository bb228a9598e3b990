"""Entities of texts by rules, expansion of questions by a dictionary, names for a graph, and two extractors checked against each other.

An entity is a row; rules are tagged arrays of matches that are exploded together, so a text of any length costs rows and not
comparisons. The expressions treat letters as Unicode does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# --- Fixed values: rules in the order in which they claim a form, with their confidences; words that are no entities; other names ---
RULES = [
    ("acronym", 0.9, r"\b[A-Z]\.?[A-Z]\.?[A-Z]?\.?[A-Z]?\.?[A-Z]?s?\b"),
    ("technical", 0.85, r"\b[A-Z][a-zA-Z0-9]*[-]?[0-9]*[a-zA-Z0-9]*\b"),
    ("proper_noun", 0.75, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    ("chinese", 0.8, r"[\x{4e00}-\x{9fff}]{2,}"),
    ("technical_phrase", 0.7, r"(?i)\b(?:transformer|attention|architecture|mechanism|injection|neural|network|deep|machine|learning|language|model|processing)\b"),
]
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did "
    "will would should could may might can this that these those what which who when where why how"
).split()
ALIASES = {
    "ai": "artificial intelligence", "a.i.": "artificial intelligence", "llm": "large language model", "llms": "large language model",
    "大模型": "large language model", "网络安全": "cybersecurity", "资安": "cybersecurity",
}
NAMES = [
    r"[\x{4e00}-\x{9fff}]{2,}",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    r"\b[A-Z]{2,6}\b",
    r"\d+(?:\.\d+)?[年月日%]",
]
NO_NAMES = ["这个", "那个", "什么", "怎么", "如何", "可以", "应该", "The", "This", "That", "What", "How", "Can", "Should"]
ASKED = [
    r"\b[A-Z]{2,6}\b",
    r"(?i)\b(?:machine learning|deep learning|neural network|natural language|computer vision|data science|artificial intelligence)\b",
    r"\b(?:[a-z]+[A-Z][a-z]*)+\b",
    r"(?:机器学习|深度学习|人工智能|神经网络|自然语言处理|计算机视觉|数据科学)",
]
BOOST = 1.15
# --- end of fixed values ---

#: Lengths that one list of forms covers when forms near one another are looked for.
BAND = 8


def tagged(text: str | Column, patterns: Sequence[str]) -> Column:
    """All matches as (rule, at, text): rule after rule, in the order of the text."""

    def of(k: int, pattern: str) -> Column:
        return F.transform(T.matches(text, f"(?U){pattern}"), lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("at"), x.alias("text")))

    return F.concat(*[of(k, p) for k, p in enumerate(patterns)])


def _first_forms(found: DataFrame, doc: str) -> DataFrame:
    """(doc, key, rule, at, text) of each lower-cased form where it comes first."""
    first = found.groupBy(doc, F.lower("text").alias("key")).agg(F.min(F.struct("rule", "at", "text")).alias("f"))
    return first.select(doc, "key", "f.rule", "f.at", "f.text")


def by_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, text, key, type, confidence): the first rule that sees a lower-cased form has it; the surest first, then by rule and place.

    Dots leave acronyms; stop words, short forms and technical terms without hyphen or digit don't count. Rows that share an id are
    one text; a null or empty text has no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(tagged(text_col, [p for _, _, p in RULES])).alias("x")).select("doc", "x.rule", "x.at", "x.text")
    kind = {name: F.col("rule") == k for k, (name, _, _) in enumerate(RULES)}
    rows = rows.withColumn("text", F.when(kind["acronym"], F.replace("text", F.lit("."), F.lit(""))).otherwise(F.col("text")))
    n, plain = F.length("text"), ~F.lower("text").isin(STOP_WORDS)
    fine = (
        F.when(kind["acronym"], (n >= 2) & plain)
        .when(kind["technical"], (n >= 3) & plain & F.col("text").rlike("[-0-9]"))
        .when(kind["proper_noun"], plain)
        .when(kind["technical_phrase"], (n >= 4) & plain)
        .otherwise(F.lit(True))
    )
    confidence = F.element_at(F.array(*[F.lit(c) for _, c, _ in RULES]), F.col("rule") + 1)
    names = F.element_at(F.array(*[F.lit(x) for x, _, _ in RULES]), F.col("rule") + 1)
    first = _first_forms(rows.filter(fine), "doc").withColumns({"confidence": confidence, "type": names})
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("confidence"), "rule", "at"))
    return first.select("doc", place.alias("place"), "text", "key", "type", "confidence")


def names(docs: DataFrame, most: int = 10, shortest: int = 2, longest: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, text, count): Chinese runs, capitalised words, acronyms and numbers with a unit; the longest first, those of one length by spelling."""
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(tagged(text_col, NAMES)).alias("x")).select("doc", "x.rule", "x.text")
    words = F.col("rule") <= 1
    fine = ~words | (F.length("text").between(shortest, longest) & ~F.col("text").isin(NO_NAMES))
    counts = rows.filter(fine).groupBy("doc", "text").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.length("text")), "text"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).select("doc", "place", "text", "count")


def normal_name(c: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """A name as a graph has it: in lower case, by the aliases of the name itself, without dots, or without dots and a plural s."""
    known = F.create_map(*[F.lit(x) for pair in sorted((ALIASES if aliases is None else aliases).items()) for x in pair])
    low = F.trim(F.lower(T.text(c)))
    bare = F.replace(low, F.lit("."), F.lit(""))
    single = F.when(bare.endswith("s") & (F.length(bare) > 2), F.substr(bare, F.lit(1), F.length(bare) - 1))
    return F.coalesce(F.element_at(known, low), F.element_at(known, bare), F.element_at(known, single), low)


def asked(questions: DataFrame, id_col: str = "query", text_col: str = "text") -> DataFrame:
    """(query, place, text): acronyms, compound terms, camelCase and Chinese terms of a question, each form once in any case."""
    rows = questions.select(F.col(id_col).alias("query"), F.explode(tagged(F.trim(T.text(text_col)), ASKED)).alias("x")).select("query", "x.rule", "x.at", "x.text")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rule", "at"))
    return _first_forms(rows, "query").select("query", place.alias("place"), "text")


def expanded(questions: DataFrame, synonyms: DataFrame, ratio: float = 3.0, most: int = 3, id_col: str = "query", text_col: str = "text") -> DataFrame:
    """(query, expanded): the question and behind it the synonyms of its entities that it doesn't hold yet.

    `synonyms` has a row (term, synonyms) for each term, in lower case or as written; a term given twice has the lists of both in the
    order of spelling. If the result is over `ratio` times as long as the question, only the first `most` synonyms stay.
    """
    listed = synonyms.groupBy("term").agg(F.flatten(F.array_sort(F.collect_list("synonyms"))).alias("list"))
    found = asked(questions, id_col, text_col)
    low = found.join(listed.select(F.col("term").alias("_low"), F.col("list").alias("by_low")), F.lower("text") == F.col("_low"), "left")
    both = low.join(listed.select(F.col("term").alias("_own"), F.col("list").alias("by_own")), F.col("text") == F.col("_own"), "left")
    words = both.select("query", "place", F.posexplode(F.coalesce("by_low", "by_own")).alias("at", "synonym"))
    first = words.groupBy("query", F.lower("synonym").alias("key")).agg(F.min(F.struct("place", "at", "synonym")).alias("f"))
    asked_ = questions.select(F.col(id_col).alias("query"), F.trim(T.text(text_col)).alias("text"))
    new = first.join(asked_, "query").filter(~F.contains(F.lower("text"), "key"))
    lists = new.groupBy("query").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["synonym"]).alias("new"))
    put = lambda words: F.concat("text", F.lit(" "), F.array_join(words, " "))
    whole = F.when(F.length(put("new")) > F.length("text") * ratio, put(F.slice("new", 1, most))).otherwise(put("new"))
    return asked_.join(lists, "query", "left").select("query", F.when(F.col("new").isNotNull(), whole).otherwise(F.col("text")).alias("expanded"))


def agreed(ours: DataFrame, theirs: DataFrame, distance: int = 2) -> DataFrame:
    """(doc, text, confidence, by_both, ours): the entities of two extractors as one list per text.

    Both have (doc, place, text, confidence). Of their forms that are equal in lower case the first counts. One of ours that is equal to
    one of theirs, or else within the edit distance of one (the nearest, then the first), raises its confidence by `BOOST`, up to 1; the
    rest are new. Their forms of a text lie in lists by length, and one of ours meets the one list that holds all lengths near its own.
    """
    low = F.lower(F.trim("text"))
    mine = ours.select("doc", F.trim("text").alias("text"), low.alias("low"), "confidence").withColumn("band", F.floor(F.length("low") / BAND))
    known = theirs.select("doc", "place", F.trim("text").alias("text"), low.alias("low"), "confidence")
    known = known.groupBy("doc", "low").agg(F.min(F.struct("place", "text", "confidence")).alias("f"))
    n = F.length("low")
    bands = F.sequence(F.floor(F.greatest(n - distance, F.lit(0)) / BAND), F.floor((n + distance) / BAND))
    lists = known.select("doc", F.explode(bands).alias("band"), F.struct("f.place", "low").alias("x")).groupBy("doc", "band").agg(F.collect_list("x").alias("near"))
    away = lambda x: F.when(F.abs(F.length("low") - F.length(x["low"])) <= distance, F.levenshtein(F.col("low"), x["low"], distance))
    measured = F.transform("near", lambda x: F.struct(away(x).alias("d"), x["place"].alias("place"), x["low"].alias("low")))
    best = F.array_min(F.filter(measured, lambda m: m["d"] >= 0))["low"]  # an equal form is at distance 0; one too far at -1 or null
    matched = mine.join(lists, ["doc", "band"], "left").select("doc", "text", "confidence", best.alias("to"))
    votes = matched.filter("to is not null").groupBy("doc", F.col("to").alias("low")).agg(F.count("*").alias("n"))
    raised = known.select("doc", "low", "f.text", "f.confidence").join(votes, ["doc", "low"], "left").select(
        "doc", "text", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("confidence") * F.pow(F.lit(BOOST), "n"))).otherwise(F.col("confidence")).alias("confidence"),
        (F.coalesce("n", F.lit(0)) > 0).alias("by_both"), F.lit(False).alias("ours"),
    )
    return raised.unionByName(matched.filter("to is null").select("doc", "text", "confidence", F.lit(False).alias("by_both"), F.lit(True).alias("ours")))
