"""Retrieval and evaluation queries: benchmark passages against documents, sample vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import evaluation as E
from sparkloom.operators import retrieval as R
from sparkloom.plans.registry import query
from sparkloom.sources.shared import written_once
from sparkloom.sources.tables import table

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]')"


def _bm25_sql(where: str = "true", k: int = 5) -> str:
    return f"""w AS MATERIALIZED (SELECT doc_id, {_TOK} AS w FROM documents WHERE {where}), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term),
    raw AS (SELECT term, m, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, s), mean AS (SELECT avg(idf) AS mi FROM raw),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    sc AS (SELECT q.item_id AS query, tf.doc_id AS doc, round(sum(times * CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 8) AS score
      FROM tf JOIN raw USING (term) JOIN q USING (term), mean GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= {k} AND score > 0)"""


_OVERLAP = f"""oq AS (SELECT item_id AS query, unnest(list_distinct({_TOK})) AS term FROM benchmark), od AS (SELECT doc_id AS doc, unnest(list_distinct({_TOK})) AS term FROM documents),
    os AS (SELECT query, doc, CAST(count(*) AS DOUBLE) AS score FROM oq JOIN od USING (term) GROUP BY ALL),
    ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM os) WHERE rank <= 10)"""

_FUSED = f"""{_bm25_sql(k=10)}, {_OVERLAP}, long AS (SELECT query, doc, 'bm25' AS channel, score, 0.4 / (60 + rank) AS part FROM bm UNION ALL SELECT query, doc, 'overlap', score, 0.6 / (60 + rank) FROM ov),
    fu AS (SELECT query, doc, round(sum(part), 10) AS hybrid_score, count(DISTINCT channel) AS n_channels, max(CASE WHEN channel = 'bm25' THEN score END) AS bm25_score, max(CASE WHEN channel = 'overlap' THEN score END) AS overlap_score FROM long GROUP BY ALL)"""


@query("retrieve_bm25", f"WITH {_bm25_sql()} SELECT query, doc, round(score, 5) AS score, rank FROM bm")
def retrieve_bm25(spark, sf_dir):
    out = R.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5)
    return out.select("query", "doc", F.round("score", 5).alias("score"), "rank")


@query("retrieve_bm25_scoped", f"WITH {_bm25_sql(where='source IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39) + ')')} SELECT query, doc, round(score, 5) AS score, rank FROM bm")
def retrieve_bm25_scoped(spark, sf_dir):
    docs = R.scoped(table(spark, sf_dir, "documents"), ["src1", "src2"])
    return R.bm25(docs, table(spark, sf_dir, "benchmark"), 5).select("query", "doc", F.round("score", 5).alias("score"), "rank")


_DENSE = """c AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
    de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM c) WHERE rank <= 10)"""


@query("retrieve_dense", f"WITH {_DENSE} SELECT query, doc, round(score, 4) AS score, rank FROM de")
def retrieve_dense(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.dense(v, v.filter("vec_id % 50 = 0"), 10).select("query", "doc", F.round("score", 4).alias("score"), "rank")


@query("retrieve_dense_relaxed", f"WITH {_DENSE}, h AS (SELECT *, max(CAST(score >= 0.95 AS INT)) OVER (PARTITION BY query) AS hit FROM de WHERE query <> doc) SELECT query, doc, rank FROM h WHERE score >= 0.95 OR (hit = 0 AND score >= 0.2)")
def retrieve_dense_relaxed(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.relaxed(R.dense(v, v.filter("vec_id % 50 = 0"), 10).filter("query <> doc"), 0.95, 0.2).select("query", "doc", "rank")


def _fused(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = R.tokenised(docs)
    return R.fuse({"bm25": (R.bm25(docs, asked, 10, words=words), 0.4), "overlap": (R.overlap_search(docs, asked, 10, words=words), 0.6)})


@query("retrieve_fused", f"WITH {_FUSED} SELECT query, doc, round(hybrid_score, 8) AS hybrid_score, n_channels, round(bm25_score, 5) AS bm25_score, overlap_score FROM fu")
def retrieve_fused(spark, sf_dir):
    out = _fused(spark, sf_dir)
    return out.select("query", "doc", F.round("hybrid_score", 8).alias("hybrid_score"), F.size("channels").cast("long").alias("n_channels"), F.round("bm25_score", 5).alias("bm25_score"), "overlap_score")


_RERANK = f"""{_FUSED}, ca AS (SELECT fu.*, b.text AS query_text, d.text AS text, d.source FROM fu JOIN benchmark b ON b.item_id = fu.query JOIN documents d ON d.doc_id = fu.doc),
    tk AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(query_text, '')), '[A-Za-z0-9_\\-]+|[\\x{{4e00}}-\\x{{9fff}}]')) AS qt, {_TOK} AS dt, max(hybrid_score) OVER (PARTITION BY query) AS best FROM ca),
    rs AS (SELECT query, doc, source, hybrid_score, round(CASE WHEN len(qt) = 0 THEN hybrid_score ELSE 0.7 * len(list_intersect(qt, dt)) / len(qt) + 0.3 * hybrid_score / CASE WHEN best > 0.01 THEN best ELSE 2.0 END END, 8) AS rerank_score FROM tk),
    rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, doc) AS rank FROM rs) WHERE rank <= 5)"""


def _candidates(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    fused = written_once(_fused(spark, sf_dir), "fused")  # its size is known then, so the texts aren't shuffled to meet it
    fused = fused.join(docs.select(F.col("doc_id").alias("doc"), "text", "source"), "doc")
    return fused.join(asked.select(F.col("item_id").alias("query"), F.col("text").alias("query_text")), "query")


@query("retrieve_reranked", f"WITH {_RERANK} SELECT query, doc, round(rerank_score, 6) AS rerank_score, rank FROM rr")
def retrieve_reranked(spark, sf_dir):
    return R.rerank_lexical(_candidates(spark, sf_dir), 5).select("query", "doc", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(
    "retrieve_parents",
    f"""WITH {_RERANK}, one AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY hybrid_score DESC, doc) AS place FROM rr),
    pa AS (SELECT source, min(doc_id) AS head FROM documents WHERE source <> 'src0' GROUP BY source)
    SELECT query, doc, source AS parent_id, CASE WHEN head IS NULL THEN 'child' ELSE 'parent' END AS granularity FROM one LEFT JOIN pa USING (source) WHERE place = 1""",
)
def retrieve_parents(spark, sf_dir):
    parents = table(spark, sf_dir, "documents").filter("source <> 'src0'").groupBy(F.col("source").alias("parent_id")).agg(F.min_by("text", "doc_id").alias("text"))
    found = R.rerank_lexical(_candidates(spark, sf_dir), 5).withColumnRenamed("source", "parent_id")
    return R.expand_parents(found, parents).select("query", "doc", "parent_id", "granularity")


@query(
    "retrieve_floor",
    f"""WITH {_RERANK}, f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, doc) AS place, count(*) FILTER (rerank_score >= 0.9) OVER (PARTITION BY query) AS good FROM rs)
    SELECT query, doc FROM f WHERE CASE WHEN good >= 3 THEN rerank_score >= 0.9 ELSE place <= 3 END""",
)
def retrieve_floor(spark, sf_dir):
    return R.with_floor(R.rerank_lexical(_candidates(spark, sf_dir), 1000), "rerank_score", 0.9, 3).select("query", "doc")


@query(
    "retrieve_features",
    f"""WITH {_FUSED} SELECT query, doc, round(0.08 * 0.6 + 0.07 * greatest(0.0, 1 - least(CAST(doc AS DOUBLE) / 365, 1.0)) + 0.05 * least(1.0, n_channels / 2), 8) AS feature FROM fu""",
)
def retrieve_features(spark, sf_dir):
    as_of = F.lit("2025-01-01").cast("timestamp")
    updated = F.timestamp_micros(F.unix_micros(as_of) - F.col("doc") * 86_400_000_000)
    rows = _fused(spark, sf_dir)
    return rows.select("query", "doc", F.round(R.rank_features(F.lit("src"), updated, F.col("channels"), as_of), 8).alias("feature"))


@query(
    "retrieve_parameters",
    r"""WITH t AS (SELECT item_id, trim(coalesce(text, '')) AS t FROM benchmark), n AS (SELECT *, len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z0-9_]+'))) AS n, length(t) - length(replace(replace(t, '?', ''), '？', '')) AS marks FROM t)
    SELECT item_id, c AS complexity, CASE c WHEN 'medium' THEN 20 WHEN 'complex' THEN 30 ELSE 15 END AS top_k, CASE c WHEN 'simple' THEN 0.3 WHEN 'complex' THEN 0.7 ELSE 0.5 END AS vector_weight FROM
    (SELECT item_id, CASE WHEN t = '' THEN 'simple' WHEN regexp_matches(t, '(?i)compare|versus|difference|relationship|impact|analyze|evaluate') OR marks >= 2 OR n > 20 THEN 'complex'
      WHEN regexp_matches(t, '(?i)(?:^|$|[^\p{L}\p{N}_])how(?:^|$|[^\p{L}\p{N}_])|explain|describe|why') OR n >= 10 THEN 'medium' ELSE 'simple' END AS c FROM n)""",
)
def retrieve_parameters(spark, sf_dir):
    c = T.retrieval_complexity("text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", c.alias("complexity"))
    level = F.col("complexity")
    return rows.select("item_id", level, F.when(level == "medium", 20).when(level == "complex", 30).otherwise(15).alias("top_k"), F.when(level == "simple", 0.3).when(level == "complex", 0.7).otherwise(0.5).alias("vector_weight"))


_KS = [1, 3, 5, 10]


def _evaluated(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = R.tokenised(docs)
    a = R.bm25(docs, asked, 10, words=words).withColumn("system", F.lit("bm25"))
    b = R.overlap_search(docs, asked, 10, words=words).withColumn("system", F.lit("overlap"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc")).distinct()
    # a stand-in for judgements: the good documents among any system's answers
    both = written_once(a.unionByName(b), "answers")
    relevant = both.select("query", "doc").distinct().join(good, "doc", "left_semi")
    return E.per_query(both.select("system", "query", "doc", "rank"), relevant, _KS)


_EVAL = f"""{_bm25_sql(k=10)}, {_OVERLAP}, sy AS (SELECT 'bm25' AS system, query, doc, rank FROM bm UNION ALL SELECT 'overlap', query, doc, rank FROM ov),
    rel AS (SELECT DISTINCT query, doc FROM sy WHERE doc IN (SELECT doc_id FROM labels WHERE quality = 1)), nr AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
    hit AS (SELECT sy.*, CAST(rel.doc IS NOT NULL AS INT) AS h FROM sy LEFT JOIN rel USING (query, doc)),
    ev AS (SELECT system, query, k, coalesce(any_value(n), 0) AS n, sum(h) FILTER (rank <= k) AS f, min(rank) FILTER (h = 1) AS first,
      coalesce(sum(h / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, coalesce(sum(h / sqrt(rank)) FILTER (rank <= k), 0) AS dcs FROM hit LEFT JOIN nr USING (query), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY ALL),
    me AS (SELECT system, query, k, f / k AS precision, CASE WHEN n > 0 THEN f / n ELSE 0 END AS recall, coalesce(1 / first, 0) AS rr,
      coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n, k)), 0) AS ndcg, coalesce(dcs / (SELECT sum(1 / sqrt(i)) FROM range(1, 11) t(i) WHERE i <= least(n, k)), 0) AS ndcg_sqrt FROM ev)"""


@query("eval_per_query", f"WITH {_EVAL} SELECT system, query, k, round(precision, 8) AS precision, round(recall, 8) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 8) AS f1, round(rr, 8) AS rr, round(ndcg, 8) AS ndcg, round(ndcg_sqrt, 8) AS ndcg_sqrt FROM me")
def eval_per_query(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("system", "query", "k", *[F.round(m, 8).alias(m) for m in E.MEASURES if m != "ndcg_tie_avg"])


@query(
    "eval_systems",
    f"""WITH {_EVAL}, m AS (SELECT system, k, count(*) AS n_queries, round(avg(precision), 8) AS precision, round(avg(recall), 8) AS recall,
    round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 8) AS f1, round(avg(rr), 8) AS rr, round(avg(ndcg), 8) AS ndcg FROM me GROUP BY system, k)
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY f1 DESC, system) AS place FROM m""",
)
def eval_systems(spark, sf_dir):
    return E.compare(_evaluated(spark, sf_dir)).select("system", "k", "n_queries", "precision", "recall", "f1", "rr", "ndcg", "place")
