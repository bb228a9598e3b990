"""Pronouns of a conversation and what they refer to: a register of the last entities, read and updated sentence by sentence.

The register along a conversation is the last few of all entities said so far, so it is a window over sentences and not a loop;
a long conversation is cut into blocks whose last entities are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ordered

# --- Fixed values: what counts as an entity, in this order; pronouns in the order in which they are looked for ---
ENTITIES = [
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    r"\b[A-Z]{2,}\b|\b[A-Z][a-z]+[A-Z][a-z]+\b",
    r"(?i)\b(?:system|database|model|application|service|framework|library|tool|method|function|class|module)\b",
]
DEMONSTRATIVES = [
    (r"\bthis\s+(?:is|was|has|can|will|should|would)\b", "this concept"),
    (r"\bthat\s+(?:is|was|has|can|will|should|would)\b", "that approach"),
    (r"\bthese\s+(?:are|were|have|can|will|should|would)\b", "these methods"),
    (r"\bthose\s+(?:are|were|have|can|will|should|would)\b", "those techniques"),
]
QUESTION_PRONOUNS = ["它", "他", "她", "这个", "那个", r"(?i)\bit\b", r"(?i)\bthis\b", r"(?i)\bthat\b"]
# --- end of fixed values ---

SPACE = r"[\s\x1c-\x1f]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def sentences(c: str | Column) -> Column:
    """Parts between runs of .!? with white space behind them, without blank ones. Only the last keeps its marks."""
    return F.filter(F.transform(F.split(T.text(c), rf"(?U)[.!?]+{SPACE}+"), trimmed), lambda x: x != "")


def mentioned(sentence: Column, most: int | None = None) -> Column:
    """Entities of a sentence, each once in any case, rule after rule; the last `most` of them."""

    def chosen(f: Column) -> Column:
        distinct = F.array_distinct(f["keys"])
        last = distinct if most is None else T.let(distinct, lambda d: F.slice(d, F.greatest(F.lit(1), F.size(d) - (most - 1)), most))
        return F.transform(last, lambda k: F.element_at(f["found"], F.array_position(f["keys"], k).cast("int")))

    found = F.concat(*[T.matches(sentence, f"(?U){p}") for p in ENTITIES])
    return T.let(T.let(found, lambda f: F.struct(f.alias("found"), F.transform(f, F.lower).alias("keys"))), chosen)


def _first(c: Column, pattern: str, put: Column) -> Column:
    """`c` with the first match replaced by a text that is taken as it is."""
    quoted = F.replace(F.replace(put, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(c, F.lit(rf"(?sU)\A(.*?)(?:{pattern})(.*)\z"), F.concat(F.lit("$1"), quoted, F.lit("$2")))


def without_pronouns(sentence: Column, recent: Column) -> Column:
    """The first It, it, This and That (before is, was, has, can or will) become the last entity, the first They the last two."""
    n = F.size(recent)
    last, other = F.get(recent, n - 1), F.get(recent, n - 2)
    verb = rf"(?={SPACE}+(?:is|was|has|can|will))"
    out = _first(_first(sentence, r"\bIt\b", last), r"\bit\b", F.lower(last))
    for word in ("This", "That"):
        out = _first(out, rf"\b{word}\b{verb}", last)
    both = F.when(n >= 2, _first(out, r"\bThey\b", F.concat(other, F.lit(" and "), last))).otherwise(out)
    return F.when(n > 0, both).otherwise(sentence)


def resolved(turns: DataFrame, by: str, order: str, text: str, most: int = 5, block: int = 64) -> DataFrame:
    """(by, order, text, resolved): each turn with the pronouns of its sentences replaced by entities said before or in the sentence.

    Turns of a conversation follow one another in `order`, those of one place by their text; the same text twice at one place is said
    once. A turn without sentences stays empty. Rows without a conversation are one conversation.
    """
    said = turns.select(by, order, T.text(text).alias("_text")).distinct()
    rows = said.select(by, order, "_text", F.posexplode_outer(sentences("_text")).alias("_s", "_sentence"))
    rows = rows.withColumn("_s", F.coalesce("_s", F.lit(-1)))
    cut = F.floor(F.coalesce(F.col(order), F.lit(0)) / block)
    with_register = ordered.recent(rows, [by], [order, "_text", "_s"], cut, mentioned(F.coalesce("_sentence", F.lit("")), most), most, "_recent")
    done = with_register.withColumn("_done", without_pronouns(F.col("_sentence"), F.col("_recent")))
    parts = F.array_sort(F.collect_list(F.when(F.col("_sentence").isNotNull(), F.struct("_s", "_done"))))
    whole = done.groupBy(by, order, "_text").agg(F.array_join(F.transform(parts, lambda x: x["_done"]), " ").alias("resolved"))
    return whole.withColumnRenamed("_text", text)


def without_demonstratives(c: str | Column) -> Column:
    """this, that, these or those with a verb behind it becomes a fixed noun (the verb goes)."""
    out = T.text(c)
    for pattern, put in DEMONSTRATIVES:
        out = F.regexp_replace(out, "(?iU)" + pattern, put)
    return out


def with_context(c: str | Column, most: int = 10, shown: int = 3) -> Column:
    """Each sentence behind the last `shown` of up to `most` entities that were new when they were said."""
    none = F.array().cast("array<string>")

    def push(stack: Column, entity: Column) -> Column:
        grown = F.concat(stack, F.array(entity))
        return F.when(F.array_contains(stack, entity), stack).when(F.size(stack) >= most, F.slice(grown, 2, most)).otherwise(grown)

    def step(state: Column, sentence: Column) -> Column:
        def after(stack: Column) -> Column:
            tail = F.slice(stack, F.greatest(F.lit(1), F.size(stack) - (shown - 1)), shown)
            said = F.when(F.size(stack) > 0, F.concat(F.lit("[Context: "), F.array_join(tail, ", "), F.lit("] "), sentence)).otherwise(sentence)
            return F.struct(stack.alias("stack"), F.concat(state["said"], F.array(said)).alias("said"))

        return T.let(F.aggregate(mentioned(sentence), state["stack"], push), after)

    return F.aggregate(sentences(c), F.struct(none.alias("stack"), none.alias("said")), step, lambda s: F.array_join(s["said"], " "))


def resolved_question(question: str | Column, entities: Column) -> Column:
    """A question in which each entity in turn replaces the first pronoun of the first kind that is left."""

    def step(q: Column, entity: Column) -> Column:
        out = F.when(F.lit(False), q)
        for p in QUESTION_PRONOUNS:
            out = out.when(q.rlike(f"(?U){p}"), _first(q, p, entity))
        return out.otherwise(q)

    return F.aggregate(entities, T.text(question), step)


def resolved_questions(turns: DataFrame, asked: Column, by: str, order: str, text: str, back: int = 10, block: int = 64) -> DataFrame:
    """(by, order, text, resolved) of the turns that are `asked`: pronouns become the entities that the `back` turns before it named most often.

    Entities of one count come in the order in which they were first named. A turn hands its entities to the places behind it, so
    a long conversation is as many groups as it has questions.
    """
    said = turns.select(by, order, T.text(text).alias("_text"), asked.alias("_asked")).distinct()
    placed = ordered.numbered(said, [by], [order, "_text", "_asked"], F.floor(F.coalesce(F.col(order), F.lit(0)) / block), "_place")
    named = placed.select(by, "_place", F.posexplode(mentioned(F.col("_text"))).alias("_i", "_entity"))
    handed = named.select(by, F.explode(F.sequence(F.col("_place") + 1, F.col("_place") + back)).alias("_to"), "_place", "_i", "_entity")
    counts = handed.groupBy(by, "_to", "_entity").agg(F.count("*").alias("_n"), F.min(F.struct("_place", "_i")).alias("_first"))
    lists = counts.groupBy(by, "_to").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_first", "_entity"))).alias("_l"))
    lists = lists.select(F.col(by).alias("_by"), "_to", F.transform("_l", lambda x: x["_entity"]).alias("_entities"))
    met = placed.filter("_asked").join(lists, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_place") == F.col("_to")), "left")
    out = F.when(F.col("_entities").isNotNull(), resolved_question("_text", F.col("_entities"))).otherwise(F.col("_text"))
    return met.select(by, order, F.col("_text").alias(text), out.alias("resolved"))
