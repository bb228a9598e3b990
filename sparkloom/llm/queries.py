"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import centroids, decomposition, embedding_dedup, importance, jaccard_join, katz, language_id, packing, quality_classifier, quality_rules, sentencepieces, substring_dedup, token_files
from sparkloom.llm.common import remainder, shared_path
from sparkloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds over all vectors, a common table each; distance and centroid in one number, so that the smallest decides ties too."""
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM kept QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v.q, min({k} * list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - w.q[i]) * (v.q[i] - w.q[i])))::BIGINT + c) AS m
        FROM kept v CROSS JOIN c{r} w GROUP BY ALL)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q
            FROM (SELECT m % {k} AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
      CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w.q, ',')) AS centroid_sha256
    FROM a{rounds} v JOIN c{rounds} w ON w.c = m % {k}"""


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "posterior")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    network = quality_classifier.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = quality_classifier.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


@query
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 10) == 0
    scored = katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_binary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = decomposition.decompose(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroids"] = _lloyd_sql()


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
