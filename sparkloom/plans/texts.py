"""Queries with text and hash functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import hashing as H
from sparkloom.functions import text as T
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]')"
_SIMILAR = r"regexp_extract_all(lower(coalesce({}, '')), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"


def _token_query(name: str, pattern: str) -> None:
    sql = f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{pattern}') AS t FROM documents)"

    @query(name, sql)
    def run(spark, sf_dir):
        t = F.col("t")
        docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text", pattern).alias("t"))
        return docs.select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


_token_query("text_tokens_bm25", T.BM25_TOKEN)
_token_query("text_tokens_graph", T.GRAPH_TOKEN)
_token_query("text_tokens_similarity", T.SIMILARITY_TOKEN)
_token_query("text_tokens_embedding", T.EMBEDDING_TOKEN)

_STOP = ", ".join(f"'{w}'" for w in T.REWRITE_STOP_WORDS)


@query(
    "text_query_keywords",
    f"""WITH t AS (SELECT item_id, u.w, u.i FROM benchmark, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T.REWRITE_TOKEN}')) WITH ORDINALITY AS u(w, i)),
    d AS (SELECT item_id, w, min(i) AS i FROM t WHERE w NOT IN ({_STOP}) GROUP BY item_id, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM d)
    SELECT item_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM r WHERE k <= 8 GROUP BY item_id""",
)
def text_query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.keywords("text"), " ").alias("keywords"))


@query(
    "text_language",
    r"""WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x{4e00}-\x{9fff}]', '', 'g')) AS h,
    length(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9\x{4e00}-\x{9fff}]', '', 'g')) AS a, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) AS l FROM documents)
    SELECT doc_id, CASE WHEN a = 0 OR h > 0.2 * a THEN 'zh' ELSE 'en' END AS language,
    CASE WHEN h + l = 0 THEN 'unknown' WHEN h > 0.7 * (h + l) THEN 'chinese' WHEN h < 0.3 * (h + l) THEN 'english' ELSE 'mixed' END AS mix,
    length(coalesce((SELECT text FROM documents d WHERE d.doc_id = c.doc_id), '')) + a + 2 * h AS ocr_score FROM c""",
)
def text_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.language("text").alias("language"), T.language_mix("text").alias("mix"), T.ocr_score("text").cast("long").alias("ocr_score"))


def _secret_sql() -> str:
    steps = ["SELECT doc_id, coalesce(text, '') AS t, 0 AS n FROM documents"]
    for p in T.SECRETS:
        steps.append(f"SELECT doc_id, regexp_replace(t, '{p}', '[REDACTED]', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM ({steps[-1]})")
    return f"SELECT doc_id, md5(t) AS digest, n AS redactions FROM ({steps[-1]})"


@query("text_redaction", _secret_sql())
def text_redaction(spark, sf_dir):
    out, n = T.redacted("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), n.cast("long").alias("redactions"))


_PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
}


@query("text_pii", "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {k}" for k, p in _PII.items()) + " FROM documents")
def text_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.pii("text").items()])


_DATES_SQL = ", ".join(f"regexp_extract_all(coalesce(text, ''), '{p}')" for p in T.DATES)


@query("text_dates", f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([{_DATES_SQL}]))), ',') AS dates FROM documents")
def text_dates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.dates("text"), ",").alias("dates"))


@query(
    "text_numbers",
    rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{T.NUMBER}')) AS m FROM documents),
    v AS (SELECT doc_id, try_cast(regexp_replace(m, '[A-Za-z,$%\s]', '', 'g') AS DOUBLE) * CASE WHEN contains(m, '%') THEN 1.0
      WHEN contains(lower(m), 'billion') OR contains(m, 'B') THEN 1e9 WHEN contains(lower(m), 'million') OR contains(m, 'M') THEN 1e6
      WHEN contains(lower(m), 'thousand') OR contains(m, 'K') THEN 1e3 ELSE 1.0 END AS x FROM m)
    SELECT doc_id, count(x) AS n, round(sum(x), 4) AS total, round(max(x), 4) AS largest FROM v GROUP BY doc_id""",
)
def text_numbers(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbers("text")).alias("x"))
    return x.groupBy("doc_id").agg(F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("total"), F.round(F.max("x"), 4).alias("largest"))


@query(
    "text_page_lines",
    f"""SELECT doc_id, md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(trim(x), '{T.PAGE_LINE}')), chr(10))) AS digest,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(trim(x), '{T.PAGE_LINE}'))) AS dropped FROM documents""",
)
def text_page_lines(spark, sf_dir):
    lines = F.split(T.text("text"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_page_lines("text")).alias("digest"), F.size(F.filter(lines, lambda x: F.trim(x).rlike(T.PAGE_LINE))).cast("long").alias("dropped"))


def _sentence_sql() -> str:
    held = "trim(coalesce(text, ''))"
    for a in T.ABBREVIATIONS:
        held = f"replace(replace({held}, '{a}', '{a.replace('.', '<ABBR>')}'), '{a.upper()}', '{a.upper().replace('.', '<ABBR>')}')"
    return f"""WITH h AS (SELECT doc_id, trim(coalesce(text, '')) AS raw, {held} AS h FROM documents),
    p AS (SELECT doc_id, raw, list_filter(list_transform(regexp_extract_all(h, '[^。！？.!?]+[。！？.!?]?'), lambda x: trim(replace(x, '<ABBR>', '.'))), lambda x: length(x) >= 3) AS s FROM h)
    SELECT doc_id, CASE WHEN raw = '' THEN 0 WHEN len(s) = 0 THEN 1 ELSE len(s) END AS n, CASE WHEN len(s) = 0 THEN md5(raw) ELSE md5(array_to_string(s, '|')) END AS digest FROM p"""


@query("text_sentences", _sentence_sql())
def text_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


_TURNS = """WITH p AS (SELECT *, lag(role) OVER w AS last_role, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM p WHERE role = 'assistant' AND last_role = 'user'"""


def _pairs(spark, sf_dir):
    """Each answer with the user's turn before it: turns without text don't count, and a question answers once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant") & (F.trim(T.text("text")) != ""))
    return turns.withColumns({"last_role": F.lag("role").over(w), "question": F.lag("text").over(w)}).filter("role = 'assistant' and last_role = 'user'")


@query(
    "text_answer_similarity",
    f"""WITH q AS ({_TURNS}), t AS (SELECT conv_id, turn, list_distinct({_SIMILAR.format('question')}) AS a, list_distinct({_SIMILAR.format('text')}) AS b FROM q)
    SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 8) AS jaccard,
    round(CASE WHEN len(b) = 0 OR len(a) = 0 THEN 0.0 ELSE len(list_intersect(b, a)) / len(b) END, 8) AS support FROM t""",
)
def text_answer_similarity(spark, sf_dir):
    a, b = (T.tokens(c, T.SIMILARITY_TOKEN) for c in ("question", "text"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(a, b), 8).alias("jaccard"), F.round(T.support(F.col("text"), F.array_distinct(a)), 8).alias("support"))


def _bounded(pattern: str) -> str:
    """Word boundaries that know all letters, for an engine whose own know ASCII."""
    edge = r"(?:^|$|[^\p{L}\p{N}_])"
    return pattern.replace(r"\b", edge)


@query(
    "text_intents",
    "SELECT conv_id, turn, CASE WHEN lower(trim(coalesce(text, ''))) = '' THEN 'general' "
    + " ".join(f"WHEN regexp_matches(lower(trim(coalesce(text, ''))), '{_bounded(p)}') THEN '{n}'" for n, p in T.AGENT_CLASSES)
    + " ELSE 'general' END AS agent_class, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in T.RELATIONS)
    + " ELSE 'RELATED_TO' END AS relation, "
    + " OR ".join(f"contains(lower(coalesce(text, '')), '{h}')" for h in T.HEDGES)
    + " AS hedged FROM conversations",
)
def text_intents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.agent_class("text").alias("agent_class"), T.relation("text").alias("relation"), T.hedged("text").alias("hedged"))


@query(
    "hash_ids",
    """SELECT doc_id, 'chunk-' || substr(sha1(coalesce(source, '') || '||' || CAST(doc_id AS VARCHAR) || '|' || substr(sha1(coalesce(text, '')), 1, 16)), 1, 16) AS chunk_id,
    'parent-' || substr(sha1(coalesce(source, '') || '|' || CAST(doc_id AS VARCHAR) || '|0'), 1, 12) AS parent_id,
    'doc-' || substr(sha1(coalesce(lang, '') || '|' || coalesce(source, '')), 1, 16) AS document_id, sha256(coalesce(text, '')) AS content_sha256,
    CAST(CAST('0x' || substr(sha256('seed|' || CAST(doc_id AS VARCHAR) || '|' || coalesce(source, '')), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM documents""",
)
def hash_ids(spark, sf_dir):
    doc, source = F.col("doc_id"), F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        H.chunk_id(source, F.lit(None), doc, F.col("text")).alias("chunk_id"),
        H.parent_id(source, doc, F.lit(0)).alias("parent_id"),
        H.document_id(F.col("lang"), source).alias("document_id"),
        F.sha2(T.text("text"), 256).alias("content_sha256"),
        H.bucket(F.lit("seed"), doc, source).alias("bucket"),
    )
