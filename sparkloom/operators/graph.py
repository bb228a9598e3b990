"""Entity graphs as edge tables: rule triplets, upsert, search, one and two hops, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

ENTITY = r"\b([A-Z][A-Za-z0-9_\-]{2,}|[\x{4e00}-\x{9fff}]{2,12})\b"


def entity_counts(docs: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", pattern: str = ENTITY) -> DataFrame:
    """(doc, entity, count, rank) of each text's most frequent entities; of equal counts the first in the text."""
    found = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.regexp_extract_all(T.text(text_col), F.lit(pattern), F.lit(0))).alias("i", "entity"))
    counts = found.groupBy("doc", "entity").agg(F.count("*").alias("count"), F.min("i").alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("count"), "first"))).filter(F.col("rank") <= n).drop("first")


def rule_triplets(docs: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", pattern: str = ENTITY, counts: DataFrame | None = None) -> DataFrame:
    """(doc, head, relation, tail): each frequent entity and the next, related by the first cue word of the text; `counts` is what `entity_counts` gave."""
    tail = F.lead("entity").over(Window.partitionBy("doc").orderBy("rank"))
    counts = entity_counts(docs, n, id_col, text_col, pattern) if counts is None else counts
    pairs = counts.select("doc", F.col("entity").alias("head"), tail.alias("tail")).filter("tail is not null")
    return pairs.join(docs.select(F.col(id_col).alias("doc"), T.relation(text_col).alias("relation")), "doc").select("doc", "head", "relation", "tail")


def best_triplets(triplets: DataFrame, least: float = 0.5) -> DataFrame:
    """Per trimmed triplet the highest confidence from `least` on; empty parts and loops go."""
    parts = triplets.withColumns({c: F.trim(c) for c in ("head", "relation", "tail")})
    fine = parts.filter((F.col("confidence") >= least) & (F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != "") & (F.col("head") != F.col("tail")))
    return fine.groupBy("head", "relation", "tail").agg(F.max("confidence").alias("confidence"))


def edges(triplets: DataFrame) -> DataFrame:
    """One row per (head, relation, tail): sorted sources, greatest, number and mean of confidences."""
    return triplets.groupBy("head", "relation", "tail").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence_max"), F.count("confidence").alias("confidence_count"), F.avg("confidence").alias("confidence_avg")
    )


def undirected(graph: DataFrame) -> DataFrame:
    """(edge, entity, relation, other) of each edge from both ends; a loop has one."""
    named = graph.withColumn("edge", F.struct("head", "relation", "tail"))
    there = named.select("edge", F.col("head").alias("entity"), "relation", F.col("tail").alias("other"))
    return there.unionByName(named.filter("head <> tail").select("edge", F.col("tail").alias("entity"), "relation", F.col("head").alias("other")))


def in_scope(graph: DataFrame, allowed: list[str] | None) -> DataFrame:
    """Edges with a source that is allowed; None raises an error, an empty list gives none."""
    if allowed is None:
        raise ValueError("a source scope is required")
    return graph.filter(F.arrays_overlap("sources", F.array(*map(F.lit, allowed)))) if allowed else graph.filter(F.lit(False))


def neighbours(graph: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(entity, relation, other, place): at most `limit` of each entity by relation and other; an entity without any has one row of nulls."""
    near = entities.select("entity").distinct().join(undirected(graph).drop("edge").distinct(), "entity")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("relation", "other"))).filter(F.col("place") <= limit)
    return entities.select("entity").distinct().join(near, "entity", "left")


def two_hops(graph: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(source, rel1, middle, rel2, target, place): paths of two different edges that don't come back, the first `limit` by middle, target and relations.

    Of a middle's neighbours only the first `limit` and one more count (that one may be the source), so a hub in the middle doesn't
    send each pair of its neighbours. `graph` is read twice: write it first.
    """
    u = undirected(graph)
    first = entities.select("entity").distinct().join(u, "entity").select(F.col("edge").alias("e1"), F.col("entity").alias("source"), F.col("relation").alias("rel1"), F.col("other").alias("middle"))
    near = u.withColumn("_d", F.dense_rank().over(Window.partitionBy("entity").orderBy("other"))).filter(F.col("_d") <= limit + 1)
    second = near.select(F.col("edge").alias("e2"), F.col("entity").alias("middle"), F.col("relation").alias("rel2"), F.col("other").alias("target"))
    paths = first.join(second, "middle").filter("e1 <> e2 and source <> target").select("source", "rel1", "middle", "rel2", "target").distinct()
    w = Window.partitionBy("source").orderBy("middle", "target", "rel1", "rel2")
    return paths.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def search(graph: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """(entity, related): entities whose lower-cased name holds a word, with up to `limit` of their neighbours' names."""
    low = F.lower("entity")
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    near = undirected(graph).filter(hit).select("entity", "other").distinct()
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("other"))).filter(F.col("place") <= limit)
    return near.groupBy("entity").agg(F.array_sort(F.collect_list("other")).alias("related"))


def without_source(graph: DataFrame, source: str) -> DataFrame:
    """The graph after a source is deleted: edges that only it had go."""
    return graph.withColumn("sources", F.array_remove("sources", source)).filter(F.size("sources") > 0)


def signal(entities: Column, neighbours_: Column, paths: Column) -> Column:
    """0 to 1 from the numbers of entities, neighbours and paths found."""
    return F.least(F.lit(1.0), 0.3 * F.least(F.lit(1.0), entities / 4) + 0.4 * F.least(F.lit(1.0), neighbours_ / 12) + 0.3 * F.least(F.lit(1.0), paths / 8))


def fuzzy_matches(names: DataFrame, entities: DataFrame, distance: int = 2) -> DataFrame:
    """(name, entity, distance): the nearest entity within an edit distance; exact ones first, then by name.

    Candidates share a deletion of up to `distance` characters: a key join finds them all, no name meets every entity.
    """

    def keyed(df: DataFrame, col: str) -> DataFrame:
        out = df.select(col, F.lower(col).alias("key"), F.lower(col).alias("low")).distinct()
        whole = out
        for _ in range(distance):
            cut = out.select(col, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda i: F.concat(F.substr(F.col("key"), F.lit(1), i - 1), F.substr(F.col("key"), i + 1)))).alias("key"), "low").distinct()
            whole, out = whole.unionByName(cut), cut
        return whole.distinct()

    met = keyed(names, "name").join(keyed(entities, "entity").withColumnRenamed("low", "other"), "key").select("name", "entity", F.levenshtein("low", "other").alias("distance")).distinct()
    best = F.row_number().over(Window.partitionBy("name").orderBy("distance", "entity"))
    return met.filter(F.col("distance") <= distance).withColumn("place", best).filter("place = 1").drop("place")
