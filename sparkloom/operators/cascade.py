"""Checks of answers in stages, of which each sees only what the one before left open, and the weighted mean of those that ran.

Rules come first and stop at personal data; then sentences against the evidence, then citations against what they cite, and last a
judge that the caller brings for answers that are in doubt. The first three are column expressions that are evaluated under the
condition of their stage; the judge gets a table of the open answers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.references import trimmed
from sparkloom.operators.verification import unmatched_numbers
from sparkloom.sources.shared import written_once

# --- Fixed values: personal data that stops a check; words that are no names; signs of a negation; shares of the stages ---
PERSONAL = [
    ("pii_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("pii_credit_card", r"\b\d{16}\b"),
    ("pii_email", r"\b[\w\.-]+@[\w\.-]+\.\w+\b"),
    ("pii_phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
]
NO_NAMES = (
    "The A An In On At To For Of With CEO CFO CTO COO President Director Manager Company Corporation Inc Ltd LLC "
    "首席执行 执行官 担任 公司 成立 实现 年成 月日 年月 融资 美元 收入 达到 增长"
).split()
NEGATION = r"(?iU)\bnot\b|\bno\b|\bnever\b|\bnone\b|\bneither\b|\bnor\b|\bn't\b|\bfailed\s+to\b|没有|不是|未|无|非|不"
NAME = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
WEIGHTS = [0.2, 0.3, 0.3, 0.2]
# --- end of fixed values ---

CHINESE = r"[\x{4e00}-\x{9fff}]"
#: A stage that ran: its name, how sure it is, what it found.
STAGE = "struct<stage:string,confidence:double,issues:array<string>>"
Judge = Callable[[DataFrame], DataFrame]


def _names(c: Column) -> Column:
    return F.concat(T.matches(c, NAME), T.matches(c, CHINESE + "{2,4}"))


def missing_names(answer: Column, source: Column) -> Column:
    """Names of several words, or Chinese ones, that the source doesn't have: no word of it, or for Chinese neither the name nor a part."""

    def missing(known: Column) -> Column:
        new = F.filter(F.array_except(_names(answer), known), lambda x: ~x.isin(NO_NAMES))

        def unknown(x: Column) -> Column:
            near = source.contains(x) | F.exists(known, lambda s: x.contains(s) | s.contains(x))
            words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
            return F.when(x.rlike(f"^{CHINESE}"), ~near).otherwise(x.contains(" ") & ~F.forall(words, lambda w: source.contains(w)))

        return F.filter(new, unknown)

    return T.let(F.array_distinct(_names(source)), missing)


def negation_conflict(answer: Column, source: Column) -> Column:
    """Just one side negates, and both speak of the same: two words or word stems in common, one of each, or a Chinese run."""
    def words(c: Column) -> Column:
        han = F.array_distinct(T.matches(c, CHINESE + "{2,4}"))
        return F.struct(han.alias("han"), F.array_distinct(F.concat(T.matches(F.lower(c), r"(?U)\b\w{3,}\b"), han)).alias("all"))

    def stem(x: Column) -> Column:
        return F.left(x, F.lit(4))

    def alike(w: Column) -> Column:
        a, s = w["a"]["all"], w["s"]["all"]
        shared = F.size(F.array_intersect(a, s))
        stems = F.array_distinct(F.transform(F.filter(s, lambda x: F.length(x) >= 4), stem))
        stemmed = T.let(stems, lambda known: F.size(F.filter(a, lambda x: (F.length(x) >= 4) & F.array_contains(known, stem(x)))))
        return F.arrays_overlap(w["a"]["han"], w["s"]["han"]) | (shared >= 2) | ((shared >= 1) & (stemmed >= 1)) | (stemmed >= 2)

    both = F.struct(words(answer).alias("a"), words(source).alias("s"))
    return F.when(answer.rlike(NEGATION) != source.rlike(NEGATION), T.let(both, alike)).otherwise(False)


def _issue(name: str, when: Column) -> Column:
    return F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def rule_issues(answer: Column, source: Column) -> Column:
    """date_mismatch, number_mismatch (once per number), entity_mismatch, negation_conflict; none where answer or source is empty."""
    def issues(f: Column) -> Column:
        off = F.when((F.size(f["n"]) > 0) & (F.size(f["n_source"]) > 0), F.size(unmatched_numbers(f["n"], f["n_source"]))).otherwise(0)
        return F.concat(
            _issue("date_mismatch", (F.size(f["d_source"]) > 0) & (F.size(F.array_except(f["d"], f["d_source"])) > 0)),
            F.array_repeat(F.lit("number_mismatch"), off),
            _issue("entity_mismatch", F.size(missing_names(answer, source)) > 0),
            _issue("negation_conflict", negation_conflict(answer, source)),
        )

    figures = F.struct(T.dates(answer).alias("d"), T.dates(source).alias("d_source"), T.numbers(answer).alias("n"), T.numbers(source).alias("n_source"))
    return F.when((answer != "") & (source != ""), T.let(figures, issues)).otherwise(F.array().cast("array<string>"))


def _stage(name: str, confidence: Column, issues: Column) -> Column:
    return F.struct(F.lit(name).alias("stage"), confidence.cast("double").alias("confidence"), issues.alias("issues")).cast(STAGE)


def personal(answer: Column) -> Column:
    """Kinds of personal data in the answer."""
    return F.filter(F.array(*[F.when(answer.rlike("(?U)" + p), F.lit(n)) for n, p in PERSONAL]), lambda x: x.isNotNull())


def by_rules(answer: Column, source: Column) -> Column:
    """Personal data: confidence 0. Else 0.2 less for each issue, 0 at least."""
    checked = T.let(rule_issues(answer, source), lambda issues: _stage("rules", F.greatest(F.lit(0.0), 1.0 - 0.2 * F.size(issues)), issues))
    return T.let(personal(answer), lambda found: F.when(F.size(found) > 0, _stage("rules", F.lit(0.0), found)).otherwise(checked))


def by_sentences(answer: Column, source: Column) -> Column:
    """Sentences of over 10 characters whose numbers and dates the source has, and a quarter of their words; an issue if over 30 % fail."""
    said = F.filter(F.transform(F.split(answer, r"(?U)[。！？.!?]\s*"), trimmed), lambda x: F.length(x) > 10)
    facts = F.struct(T.numbers(source).alias("numbers"), T.dates(source).alias("dates"), F.array_distinct(T.matches(F.lower(source), r"(?U)\w+")).alias("words"))

    def fails(s: Column, f: Column) -> Column:
        few = lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, f["words"])) / F.greatest(F.size(own), F.lit(1))).otherwise(0.0) < 0.25
        off = (F.size(unmatched_numbers(T.numbers(s), f["numbers"])) > 0) | (F.size(F.array_except(T.dates(s), f["dates"])) > 0)
        return off | T.let(F.array_distinct(T.matches(F.lower(s), r"(?U)\w+")), few)

    def some(v: Column) -> Column:
        return _stage("sentences", 1.0 - v["bad"] / F.greatest(v["n"], F.lit(1)), _issue("nli_contradiction", v["bad"] > v["n"] * 0.3))

    def staged(said: Column) -> Column:
        counted = T.let(facts, lambda f: F.struct(F.size(F.filter(said, lambda s: fails(s, f))).alias("bad"), F.size(said).alias("n")))
        none = F.array().cast("array<string>")
        return F.when(F.size(said) == 0, _stage("sentences", F.lit(1.0), none)).when(source == "", _stage("sentences", F.lit(0.5), none)).otherwise(T.let(counted, some))

    return T.let(said, staged)


def by_citations(answer: Column, citations: Column, docs: Column) -> Column:
    """Citations (doc, content) against the documents (doc, content) they name: 0.15 less for each issue, 0 at least.

    Numbers or dates without citation or [mark]; a document that isn't there; a cited number that its document lacks (once for each
    number of the answer).
    """

    def staged(numbers: Column) -> Column:
        bare = (F.size(citations) == 0) & (F.size(T.matches(answer, r"(?U)\[\d+\]")) == 0) & ((numbers > 0) | (F.size(T.dates(answer)) > 0))

        def one(c: Column) -> Column:
            def against(found: Column) -> Column:
                off = F.size(unmatched_numbers(T.numbers(c["content"]), T.numbers(F.get(found, F.lit(0))["content"]))) > 0
                return F.when(F.size(found) == 0, F.array(F.lit("citation_invalid"))).when(off, F.array_repeat(F.lit("citation_mismatch"), numbers)).otherwise(F.array().cast("array<string>"))

            return T.let(F.filter(docs, lambda d: d["doc"] == c["doc"]), against)

        issues = F.concat(_issue("missing_citation", bare), F.flatten(F.transform(citations, one)))
        return T.let(issues, lambda i: _stage("citations", F.greatest(F.lit(0.0), 1.0 - 0.15 * F.size(i)), i))

    return T.let(F.size(T.numbers(answer)), staged)


def validated(answers: DataFrame, judge: Judge | None = None, sentences: bool = False) -> DataFrame:
    """`answers` with stages (those that ran), issues, reached (the last stage) and confidence (their weighted mean, to three places).

    `answers` has answer, docs and citations (arrays of doc and content); null counts as empty. The evidence is the first five documents'
    text. Personal data ends an answer's check. The second and third stage run if the last one before is at least 0.5 sure, the judge
    if there are issues and a stage is less than 0.7 sure. `judge` gets the open answers and returns them with `judged`, a stage.
    """
    none = F.array().cast("array<struct<doc:string,content:string>>")
    given = answers.withColumns({"_answer": T.text("answer"), "_docs": F.coalesce("docs", none), "_citations": F.coalesce("citations", none)})
    given = given.withColumn("_source", F.array_join(F.transform(F.slice("_docs", 1, 5), lambda d: F.coalesce(d["content"], F.lit(""))), " "))
    out = given.withColumn("stages", F.array(by_rules(F.col("_answer"), F.col("_source"))))
    stops = F.size(personal(F.col("_answer"))) > 0

    def then(df: DataFrame, stage: Column) -> DataFrame:
        goes_on = lambda s: ~stops & (F.element_at(s, -1)["confidence"] >= 0.5)
        return df.withColumn("stages", T.let(F.col("stages"), lambda s: F.when(goes_on(s), F.concat(s, F.array(stage))).otherwise(s)))

    if sentences:
        out = then(out, by_sentences(F.col("_answer"), F.col("_source")))
    out = then(out, by_citations(F.col("_answer"), F.col("_citations"), F.col("_docs")))
    out = out.withColumn("issues", F.flatten(F.transform("stages", lambda s: s["issues"])))
    doubt = ~stops & (F.size("issues") > 0) & F.exists("stages", lambda s: s["confidence"] < 0.7)
    if judge is not None:
        out = written_once(out, "stages")  # both branches read it
        again = judge(out.filter(doubt)).withColumn("stages", F.concat("stages", F.array(F.col("judged").cast(STAGE)))).drop("judged")
        again = again.withColumn("issues", F.flatten(F.transform("stages", lambda s: s["issues"])))
        out = out.filter(~doubt).unionByName(again)
    weights = F.slice(F.array(*map(F.lit, WEIGHTS)), F.lit(1), F.size("stages"))
    add = lambda a, x: a + x
    whole = F.aggregate(F.zip_with("stages", weights, lambda s, w: s["confidence"] * w), F.lit(0.0), add) / F.aggregate(weights, F.lit(0.0), add)
    final = F.when(stops, 0.0).otherwise(F.round(whole + 1e-12, 3))
    return out.withColumns({"reached": F.element_at("stages", -1)["stage"], "confidence": final}).drop("_answer", "_docs", "_citations", "_source")


def support_judge(least: float = 0.5) -> Judge:
    """A judge without a model: as sure as the share of the answer's words that the evidence has, half of that below `least`."""

    def judge(open_: DataFrame) -> DataFrame:
        share = T.support(F.col("answer"), F.array_distinct(T.tokens("_source", T.SIMILARITY_TOKEN)))
        return open_.withColumn("judged", _stage("judge", F.when(share < least, share * 0.5).otherwise(share), _issue("llm_hallucination", share < least)))

    return judge
