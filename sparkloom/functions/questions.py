"""Preparing questions: normal form, stop words, synonyms, plans; scores of relations and of judges' answers. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def plain(c: str | Column) -> Column:
    """Wide spaces as spaces, runs of white space as one, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(T.text(c), "　", " "), r"\s+", " "))


def without_stop_words(words: Column, stop: list[str]) -> Column:
    """The words that aren't stop words, or the first word where all are."""
    kept = F.filter(words, lambda x: ~x.isin(stop))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 1))


def with_synonyms(words: Column, synonyms: dict[str, list[str]], most: int = 2) -> tuple[Column, Column]:
    """(words and behind each up to `most` of its synonyms in order of spelling, a query of groups joined by OR)."""
    known = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*[F.lit(s) for s in sorted(v)]))])
    none = F.array().cast("array<string>")
    group = F.transform(words, lambda w: F.concat(F.array(w), F.slice(F.coalesce(F.element_at(known, w), none), 1, most)))
    marked = F.transform(group, lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(g, " OR "), F.lit(")"))).otherwise(g[0]))
    return F.array_distinct(F.flatten(group)), F.array_join(marked, " ")


def mapped(words: Column, names: dict[str, str]) -> Column:
    """Words in lower case by a dictionary of aliases; those it lacks stay."""
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(known, F.lower(w)), F.lower(w)))


def merged(*lists: Column) -> Column:
    """Distinct entities of some lists, the longest first, those of one length by spelling."""
    return F.array_sort(F.array_distinct(F.concat(*lists)), lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def plan(level: Column, route: Column, force_web: Column) -> tuple[Column, Column, Column, Column]:
    """(route, least hits, prefers the graph, prefers the web): a complex question that goes to vectors goes to both."""
    known = F.when(route.isin("vector", "graph", "hybrid", "react"), route).otherwise("vector")
    chosen = F.when((level == "complex") & (known == "vector"), "hybrid").otherwise(known)
    return chosen, F.when(level == "simple", 1).when(level == "medium", 2).otherwise(3), chosen.isin("graph", "hybrid"), force_web


def relation_weight(relation: str | Column, noisy: list[str], strong: list[str]) -> Column:
    """0 for no relation or one of the noisy, 1 where it holds a strong word, else 0.6."""
    r = F.lower(F.trim(T.text(relation)))
    hit = F.lit(False)
    for word in strong:
        hit = hit | r.contains(word)
    return F.when((r == "") | r.isin(noisy), 0.0).when(hit, 1.0).otherwise(0.6)


def judged(answer: str | Column) -> tuple[Column, Column, Column]:
    """(score within 0 to 1, label, reason) of a judge's lines SCORE:, LABEL: and REASONING:; the last line of a kind counts."""
    lines = F.transform(F.split(F.trim(T.text(answer)), "\n"), lambda x: F.trim(x))

    def last(name: str) -> Column:
        found = F.filter(lines, lambda x: x.startswith(name))
        return F.when(F.size(found) > 0, F.trim(F.substring(F.element_at(found, -1), len(name) + 1, 1 << 30)))

    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(last("SCORE:").try_cast("double"), F.lit(0.0))))
    label = F.lower(last("LABEL:"))
    return score, F.when(label.isin("highly_relevant", "somewhat_relevant"), label).otherwise("not_relevant"), F.coalesce(last("REASONING:"), F.lit("Unable to parse response"))


def judged_all(answer: str | Column, n: Column) -> Column:
    """(score, label, reason) of each of `n` documents in a judge's answer to all of them: sections after the word Document, each with a
    line for its number. Sections of under three lines are incomplete, those that lack are missing, those too many are left out."""
    state = lambda score, label, reason: F.struct(score.alias("score"), label.alias("label"), reason.alias("reason"))
    none = lambda why: state(F.lit(0.0), F.lit("not_relevant"), F.lit(why))

    def one(section: Column) -> Column:
        lines = F.split(F.trim(section), "\n")
        body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
        return F.when(F.size(lines) < 3, none("Incomplete response")).otherwise(state(*judged(body)))

    sections = F.filter(F.split(F.trim(T.text(answer)), "Document "), lambda s: F.trim(F.translate(s, "\n", " ")) != "")
    found = F.transform(sections, one)
    missing = F.array_repeat(none("Missing response"), F.greatest(n - F.size(found), F.lit(0)).cast("int"))
    return F.slice(F.concat(found, missing), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
