"""Weighted Lloyd rounds against plain Python over all rows, and against the SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from sparkloom.llm import centroids
from sparkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("vector", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.StringType())])


def brute(rows, dims, k=8, rounds=10, seed=3):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if max(abs(1024 * x) for x in v) < centroids.LARGEST]
    order = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    means = [v for _, v in sorted(rows, key=order)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(means))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in rows]
        for j in range(len(means)):
            mine = [v for (_, v), t in zip(rows, to, strict=True) if t == j]
            if mine:
                means[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in rows]
    whole = sum(d for _, d, _ in found)
    return sorted(((i, j, d, sum(e for _, e, t in found if t == j), whole, hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def made(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.integers(-3, 4, dims) / 8]) for i in range(n)]


@pytest.mark.parametrize("dims", [2, 5])
def test_rounds_equal_plain_python(spark, dims):
    same = [0.25] * dims
    rows = [*made(120, dims, dims), *((1000 + i, same) for i in range(80)), (3, same), (3, [-0.5] * dims), (3, [-0.5] * dims), (None, same)]
    rows += [(2000, None), (2001, []), (2002, [0.5] * (dims + 1)), (2003, [None] * dims), (2004, [math.nan] * dims), (2005, [math.inf] * dims), (2006, [1e308] * dims), (2007, [1e300] * dims), (2008, [4000.5] * dims)]
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(5)
    found = centroids.cluster(table, dims=dims)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, dims)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, None), (2, [1.0])], [(i, [0.5, -0.5]) for i in range(30)]])
def test_few_vectors(spark, rows):
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, centroids.cluster(table, dims=2).collect()), key=str) == brute(rows, 2)


def test_large_integers_stay_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27) + 1], [5, 7]], np.int32)
    c = np.array([[-(1 << 27) + 1, (1 << 27) - 1], [0, 0]], np.int64)
    best, far = centroids.nearest(x, c)
    assert best.tolist() == [1, 1] and far.tolist() == [2 * ((1 << 27) - 1) ** 2, 74]


def test_ties_go_to_the_smaller_number():
    best, far = centroids.nearest(np.array([[0, 0]], np.int32), np.array([[1, 0], [0, 1], [-1, 0]]))
    assert best.tolist() == [0] and far.tolist() == [1]


def test_quantised_keeps_whole_finite_vectors():
    column = pa.array([[0.0009, -0.0001], None, [1.0], [1.0, None], [float("nan"), 0.0], [2.0, 1e20], [-0.5, 0.5]], pa.list_(pa.float64()))
    at, x = centroids.quantised(column, 2, 1024)
    assert at.tolist() == [0, 6] and x.tolist() == [[0, -1], [-512, 512]]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op12_centroids"]).fetchdf()[COLUMNS].itertuples(index=False)
    assert sorted(map(tuple, QUERIES["op12_centroids"](spark, SF).collect())) == sorted(map(tuple, want))
