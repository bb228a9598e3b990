"""Other ways to merge result lists: path frequency, votes, min-max and max normalisation; and tests of retrieved text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_paths(rows: DataFrame) -> DataFrame:
    """(query, doc): number of paths, best score and that x (1 + 0.2 for each further path)."""
    out = rows.groupBy("query", "doc").agg(F.count("*").alias("paths"), F.max("score").alias("score"))
    return out.withColumn("boosted", F.col("score") * (1 + 0.2 * (F.col("paths") - 1)))


def by_votes(rows: DataFrame, k: int) -> DataFrame:
    """(query, doc): votes and best score + 0.1 for each further vote, at most 1; the k best of a query."""
    out = rows.groupBy("query", "doc").agg(F.count("*").alias("votes"), F.max("score").alias("best"))
    out = out.withColumn("score", F.least(F.lit(1.0), F.col("best") + 0.1 * (F.col("votes") - 1)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)


def min_max(a: DataFrame, b: DataFrame, weight: float = 0.7) -> DataFrame:
    """Weighted sum of two lists' scores, each scaled to 0..1 within a query (1 where all are equal); a missing score is 0."""
    w = Window.partitionBy("query", "side")
    both = a.select("query", "doc", "score", F.lit("a").alias("side")).unionByName(b.select("query", "doc", "score", F.lit("b").alias("side")))
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = both.withColumn("s", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    return scaled.groupBy("query", "doc").agg(F.sum(F.col("s") * F.when(F.col("side") == "a", weight).otherwise(1 - weight)).alias("score"))


def over_best(dense: DataFrame, lexical: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha x dense + (1 - alpha) x lexical over the query's best lexical score; a missing score is 0."""
    best = F.max("score").over(Window.partitionBy("query"))
    lex = lexical.select("query", "doc", (F.col("score") / F.when(best > 0, best).otherwise(1.0) * (1 - alpha)).alias("part"))
    return dense.select("query", "doc", (alpha * F.col("score")).alias("part")).unionByName(lex).groupBy("query", "doc").agg(F.sum("part").alias("score"))


def must_contain(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(query, hit): whether the lower-cased texts of a query's results hold every term; without terms, whether there is a result."""
    terms = cases.select("query", F.explode_outer("must_contain").alias("term"))
    pool = results.select("query", F.lower("text").alias("low"))
    met = terms.join(pool, "query", "left").groupBy("query", "term").agg(F.max(F.when(F.col("term").isNull(), F.col("low").isNotNull()).otherwise(F.coalesce(F.col("low").contains(F.lower("term")), F.lit(False)))).alias("held"))
    return met.groupBy("query").agg(F.bool_and("held").alias("hit"))
