"""Deleting sources from all stores of an index at once: chunks, parents, registry, mentions and edges, and entities that nothing names any more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stores = dict[str, DataFrame]


def _left(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, "source", "left_anti")


def without_sources(stores: Stores, gone: DataFrame) -> Stores:
    """The stores after the sources of `gone` (a column source; nulls and repetitions don't count) are deleted.

    chunks and parents (each with source, chunks with parent_id too), registry (source), mentions (entity, source), edges (head,
    relation, tail, sources) and entities (entity). A row without source stays; a parent goes with its source, and chunks whose
    parent is gone go with it. An edge loses the sources and goes with its last one; an entity goes when neither an edge nor a mention
    that is left names it. Other columns stay. All are joins on keys: nothing depends on how many sources go.
    """
    out = gone.select("source").dropna().distinct()
    parents = _left(stores["parents"], out)
    lost = stores["parents"].join(out, "source", "left_semi").select("parent_id").dropna().distinct().join(parents.select("parent_id"), "parent_id", "left_anti")
    chunks = _left(stores["chunks"], out).join(lost, "parent_id", "left_anti").select(*stores["chunks"].columns)
    edges = stores["edges"]
    rest = [c for c in edges.columns if c != "sources"]
    hit = edges.select(F.struct("head", "relation", "tail").alias("edge"), F.explode("sources").alias("source")).join(out, "source", "left_semi")
    minus = hit.groupBy("edge").agg(F.collect_set("source").alias("_minus")).select("edge.*", "_minus")
    kept = edges.join(minus, ["head", "relation", "tail"], "left").withColumn("sources", F.when(F.col("_minus").isNull(), F.col("sources")).otherwise(F.array_except("sources", "_minus")))
    kept = kept.filter(F.size("sources") > 0).select(*[c if c in rest else "sources" for c in edges.columns])
    mentions = _left(stores["mentions"], out)
    named = reduce(DataFrame.union, (mentions.select("entity"), kept.select("head"), kept.select("tail"))).toDF("entity").distinct()
    return {
        "chunks": chunks, "parents": parents, "registry": _left(stores["registry"], out), "mentions": mentions, "edges": kept,
        "entities": stores["entities"].join(named, "entity", "left_semi"),
    }


def counts(before: Stores, after: Stores) -> DataFrame:
    """(store, removed, rows): what a deletion took from each store and what is left, counted per store and added up."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), F.lit(old).alias("old"), "n") for stores, old in ((before, True), (after, False)) for name, df in stores.items()]
    both = reduce(DataFrame.unionByName, parts).groupBy("store").agg(F.sum(F.when(F.col("old"), F.col("n"))).alias("was"), F.sum(F.when(~F.col("old"), F.col("n"))).alias("rows"))
    return both.select("store", (F.col("was") - F.col("rows")).alias("removed"), "rows")
