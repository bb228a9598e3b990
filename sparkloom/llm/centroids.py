"""Centroid clustering of quantised vectors by weighted deduplication.

Vectors become integers; equal ones are one row with a multiplicity. Lloyd's rounds read only the distinct vectors: a task
adds up, for each centroid, its vectors' integers times their multiplicities, and Spark adds the tasks' sums. All sums are whole
numbers, so the result depends neither on partitions nor on the order of rows. The driver holds the centroids and one sum per
centroid and component, whatever the input's size. In the end the distinct vectors' assignments are joined back to the rows by
the vectors' digests; a vector that a third of all rows have is one row of the distinct side, and Spark splits the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written

#: Components beyond this have squared distances that a long can't hold.
LARGEST = 1 << 27
#: Below this, products and sums of up to 64 components are exact in doubles.
EXACT = 1 << 22


def quantised(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, integer rows): the vectors of a list column that have `dims` components, none of them null, non-finite or out of range."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(at)))
    with np.errstate(over="ignore"):
        x = np.floor(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dims) * scale)
    good = (np.abs(x) < LARGEST).all(axis=1)  # no comparison with a NaN holds
    return at[good], x[good].astype("<i4")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of integer rows; the smaller number at a tie."""
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT and x.shape[1] <= 64
    kind = np.float64 if small else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best].astype(np.int64)


def kept(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the vectors that count, as packed little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = quantised(batch.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "vector"])

    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")).mapInArrow(run, "vec_id long, vector binary")


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The `k` rows with the smallest hash of seed and id; rows that share an id in the order of their vectors. Only k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(order, "vector").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r.vector) for r in found), "<i4").reshape(-1, dims).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of each component's weighted mean; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, n = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            weighted = np.column_stack([x * n[:, None], n])
            for c in range(k):
                sums[c] += weighted[best == c].sum(axis=0)
        at = np.flatnonzero(sums[:, -1].repeat(dims + 1))
        yield pa.RecordBatch.from_pydict({"place": pa.array(at), "total": pa.array(sums.ravel()[at])})

    found = distinct.select("vector", "n").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.zeros((k, dims + 1), object)
    for r in found:  # one row per centroid and component
        sums[divmod(r.place, dims + 1)] = int(r.total)
    return np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(sums.tolist(), centroids.tolist(), strict=True)], np.int64).reshape(k, dims)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vector, n, cluster, distance) of the distinct vectors."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest(_matrix(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(far)], names=["vector", "n", "cluster", "distance"])

    return distinct.select("vector", "n").mapInArrow(run, "vector binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dims` components, none null or non-finite, whose integers floor(scale * x) lie within 2**27, so that a
    squared distance fits a long. Rows that share an id, or have none, are vectors of their own; a null id counts as the text '' in the
    hash that picks the first centroids. Fewer than `k` kept vectors give fewer centroids, none an empty table. A centroid that several
    equal rows start stays empty but for the first of them and doesn't move. Inertias beyond a long are null. Other columns aren't read.
    """
    rows = kept(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed, dims)
    distinct = written(rows.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    key = F.unhex(F.sha2("vector", 256)).alias("key")
    found = written(assigned(distinct, centroids).select(key, "n", "cluster", "distance"), "assigned-vectors")
    discard(distinct)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias("of_cluster")).collect()  # a row per centroid
    whole = sum(int(r.of_cluster) for r in inertia)
    fits = lambda n: int(n) if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = vectors.sparkSession.createDataFrame([(r.cluster, fits(r.of_cluster), fits(whole), digests[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    by_vector = found.join(F.broadcast(figures), "cluster").drop("n")  # at most k rows
    return rows.select("vec_id", key).join(by_vector, "key").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
