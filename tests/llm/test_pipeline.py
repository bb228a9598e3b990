"""The pipeline's stages against brute force, each on the rows that the stage before it kept."""

import corpus_pipeline
import numpy as np
from test_near_duplicates import brute_join
from test_quality import counts

from sparkloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        kept[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            now = {r.doc_id: r.text for r in rows}
            assert set(now) <= set(before) and len(now) == len(rows)
        if name == "quality rules":
            assert all(counts(t)[0] >= 50 for t in now.values())
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert np.mean([i in now for i in good]) > 0.9
        if name == "n-gram Jaccard join":
            assert set(now) == {c for _, c in brute_join(before.items()).values()}
        if name == "substring dedup":
            assert all(len(now[i]) <= len(before[i]) for i in now)
            assert sum(len(t) for t in now.values()) > 0.5 * sum(len(t) for t in before.values())
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
        else:
            before = now


def test_run_is_registered(spark):
    from sparkloom.llm import queries

    assert "pipeline" in queries.QUERIES and corpus_pipeline.ORACLE_SQL is None
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline"} | {f"op{i}" for i in range(1, 14)}


def test_stages_keep_columns_of_any_name(spark):
    names = ["_quality", "score", "row", "_id", "kept", "votes", "copies"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns and all(r[n] == n for r in after.collect() for n in names)
        docs = after
