"""Connected components of a graph given as pairs of ids, by alternating large-star and small-star rounds.

Each round points every node's larger (then smaller) neighbours at its smallest neighbour. The number of edges never grows and
the number of rounds is about the logarithm of the longest path. A hub's edges meet in a minimum that is aggregated before
the shuffle, and in a join that adaptive execution can split, so no task holds a group. First the edges are dealt to
tasks of bounded size, which reduce their own edges to stars. Every round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written


class Forest:
    """Union-find over any hashable ids; the smallest id is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each end and the smallest id that the task's own edges lead to."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            forest.join(a, b)
    ends = list(forest.parent)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([forest.find(x) for x in ends], pa.int64())], names=["a", "b"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges dealt evenly, 100,000 to a task or as many as the shuffle partitions leave, but never over a million; each task's are reduced to stars."""
    n = edges.count()
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-n // 100_000), partitions), -(-n // 1_000_000))
    return edges.repartition(tasks).mapInArrow(_forest, "a long, b long").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component_id) of every id that an edge touches; component_id is the smallest id that is reachable.

    Edges may be repeated, in either direction, or loops; those with a null end are left out. No edges give no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    found = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    given = written(found, "edges")
    now = written(_contracted(given), "forest")
    discard(given)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(large)
        discard(now)
        now = after
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller, and that is nobody's larger end: then the smaller ends are the components."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()[0] == 0
