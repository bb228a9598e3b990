"""Checks of answers against evidence: claims, numbers, dates, conflicts, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# --- Fixed values ---
NEGATIONS = ["not ", "no ", "never", "without", "n't", "不", "没有", "无"]
SHORT_STOP = ["this", "that", "with", "from", "have", "will", "should"]
QUALITY_WEIGHTS = {"routing": 0.10, "retrieval": 0.30, "answer": 0.45, "citation": 0.10, "latency": 0.05}
# --- end of fixed values ---


def unmatched_numbers(answer: Column, source: Column, tolerance: float = 0.15) -> Column:
    """Numbers of the answer that no number of the source equals within a relative difference; two zeros match, one zero doesn't."""

    def close(a: Column, s: Column) -> Column:
        return F.when((a == 0) | (s == 0), a == s).otherwise(F.abs(a - s) / F.greatest(F.abs(a), F.abs(s)) <= tolerance)

    return T.let(source, lambda known: F.filter(answer, lambda a: ~F.exists(known, lambda s: close(a, s))))


def unsupported(pairs: DataFrame, answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """Columns for numbers and dates of the answer that the evidence lacks, and the share of the answer's tokens that it has."""
    tokens = F.array_distinct(T.tokens(evidence, T.SIMILARITY_TOKEN))
    return pairs.withColumns(
        {
            "missing_numbers": unmatched_numbers(T.numbers(answer), T.numbers(evidence)),
            "missing_dates": F.array_except(T.dates(answer), T.dates(evidence)),
            "support": T.support(F.col(answer), tokens),
            "grounded": (T.support(F.col(answer), tokens) >= 0.22) | T.hedged(answer),
        }
    )


def negated(c: str | Column) -> Column:
    low, out = F.lower(T.text(c)), F.lit(False)
    for n in NEGATIONS:
        out = out | low.contains(n)
    return out


def conflicts(evidence: DataFrame, group: str, order: str, text: str = "text", most: int = 100) -> DataFrame:
    """Per group: pairs checked (the first `most` in order), conflicting ones (a shared word, one side negated), their share, and the verdict.

    Only as many pieces as `most` pairs can hold are paired, so a large group costs no more than a small one.
    """
    w = Window.partitionBy(group).orderBy(order)
    keyed = evidence.filter(F.trim(T.text(text)) != "").withColumn("_i", F.row_number().over(w))
    words = F.filter(F.array_distinct(T.matches(F.lower(T.text(text)), "[a-zA-Z_]{4,}")), lambda x: ~x.isin(SHORT_STOP))
    rows = keyed.filter(F.col("_i") <= most + 1).select(group, "_i", words.alias("_w"), negated(text).alias("_n"))
    other = rows.select(group, *[F.col(c).alias(f"{c}2") for c in ("_i", "_w", "_n")])
    pairs = rows.join(other, group).filter("_i < _i2").withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy("_i", "_i2"))).filter(F.col("_p") <= most)
    hit = F.arrays_overlap("_w", "_w2") & (F.col("_n") != F.col("_n2"))
    out = pairs.groupBy(group).agg(F.count("*").alias("pairs_checked"), F.count_if(hit).alias("conflict_hits"))
    out = out.withColumn("score", F.round(F.col("conflict_hits") / F.col("pairs_checked"), 4))
    return out.withColumn("conflict", (F.col("score") >= 0.25) & (F.col("conflict_hits") > 0))


def evidence_score(hits: Column, entities: Column, neighbours: Column, route: Column) -> Column:
    """vector: hits / 3; graph: entities / 3 + neighbours / 12; hybrid: 0.7 and 0.3 of them; else the greater. At most 1."""
    v = F.least(F.lit(1.0), hits / 3)
    g = F.least(F.lit(1.0), entities / 3 + neighbours / 12)
    return F.when(route == "vector", v).when(route == "graph", g).when(route == "hybrid", F.least(F.lit(1.0), 0.7 * v + 0.3 * g)).otherwise(F.greatest(v, g))


def sufficient(hits: Column, entities: Column, neighbours: Column, route: Column, least: Column) -> Column:
    """Whether the evidence reaches the threshold for `least` hits; a hybrid with one strong side needs 0.2 less, 0.5 at least."""
    v, g = F.least(F.lit(1.0), hits / 3), F.least(F.lit(1.0), entities / 3 + neighbours / 12)
    threshold = F.when(least <= 1, 0.33).when(least == 2, 0.67).otherwise(1.0)
    hybrid = route == "hybrid"
    eased = F.when(hybrid & ((v >= 0.67) | (g >= 0.67)), F.greatest(F.lit(0.5), threshold - 0.2)).otherwise(threshold)
    return (hybrid & (v + g >= threshold)) | (evidence_score(hits, entities, neighbours, route) >= eased)


def quality(parts: dict[str, Column], risk: Column) -> tuple[Column, Column]:
    """(score, level): the weighted sum, x 0.7 above a risk of 0.30, x 0.8 below a routing of 0.5; levels from 0.85, 0.70 and 0.50."""
    score = sum((w * parts[n] for n, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    score = score * F.when(risk > 0.30, 0.7).otherwise(1.0) * F.when(parts["routing"] < 0.5, 0.8).otherwise(1.0)
    score = F.round(score + 1e-9, 3)  # a tie goes up, whatever the last binary digit is
    return score, F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score >= 0.50, "fair").otherwise("poor")


def decision(consistency: Column, support: Column, completeness: Column, safety: Column) -> tuple[Column, Column]:
    """(score, action): weights .40, .25, .25, .10; approve from 0.80, flag from 0.60, else regenerate."""
    score = 0.40 * consistency + 0.25 * support + 0.25 * completeness + 0.10 * safety
    return score, F.when(score >= 0.80, "approve").when(score >= 0.60, "flag").otherwise("regenerate")
