"""Ranking metrics over retrieved lists and relevant sets, and comparisons of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(retrieved: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(system, query, k, precision, recall, f1, rr, ndcg, ndcg_tie_avg, ndcg_sqrt) from retrieved (system, query, doc, rank) and relevant (query, doc).

    Precision divides by k always. rr looks at the whole list. ndcg is the textbook measure; ndcg_tie_avg takes the relevant documents
    found, not all of them, as ideal, and averages over ties; ndcg_sqrt discounts by the root of the place.
    """
    sizes = relevant.distinct().groupBy("query").agg(F.count("*").alias("n_relevant"))
    hits = retrieved.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query", "doc"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    lists = hits.groupBy("system", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "hit"))).alias("l"))  # a retrieved list is short
    one = lists.select("system", "query", F.transform("l", lambda x: x["hit"]).alias("h")).join(sizes, "query", "left")
    one = one.withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).withColumn("first", F.array_position("h", 1))
    at = one.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("top", F.slice("h", F.lit(1), F.col("k")))
    found = F.aggregate("top", F.lit(0), lambda a, x: a + x)
    at = at.withColumn("found", found)

    def gains(values, weight):
        return F.aggregate(F.transform(values, lambda x, i: x * weight(i + 1)), F.lit(0.0), lambda a, x: a + x)

    log2 = lambda i: 1 / F.log2(i + 1)
    root = lambda i: 1 / F.sqrt(i)

    def ideal(n, weight):
        return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), weight), F.lit(0.0), lambda a, x: a + x))

    n, k, f = F.least("n_relevant", "k"), F.col("k"), F.col("found")
    early = F.aggregate(F.slice("top", F.lit(1), F.greatest(f, F.lit(1))), F.lit(0), lambda a, x: a + x)
    head, whole = ideal(f, log2), ideal(k, log2)
    tie = (early / f) * head + F.when(f < k, (f - early) / (k - f) * (whole - head)).otherwise(0.0)
    precision, recall = f / k, F.when(F.col("n_relevant") > 0, f / F.col("n_relevant")).otherwise(0.0)
    return at.select(
        "system", "query", "k",
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0).alias("rr"),
        F.coalesce(gains("top", log2) / ideal(n, log2), F.lit(0.0)).alias("ndcg"),
        F.when(f > 0, tie / head).otherwise(0.0).alias("ndcg_tie_avg"),
        F.coalesce(gains("top", root) / ideal(n, root), F.lit(0.0)).alias("ndcg_sqrt"),
    )


MEASURES = ["precision", "recall", "f1", "rr", "ndcg", "ndcg_tie_avg", "ndcg_sqrt"]


def compare(metrics: DataFrame) -> DataFrame:
    """Means over queries of each system and k, and the system's place at that k by F1."""
    from pyspark.sql import Window

    means = metrics.groupBy("system", "k").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 8).alias(m) for m in MEASURES])
    return means.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("f1"), "system")))
