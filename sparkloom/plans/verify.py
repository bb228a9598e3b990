"""Verification of answers, other fusions, document structure and audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectorised as V
from sparkloom.operators import merging as M
from sparkloom.operators import retrieval as R
from sparkloom.operators import structure as S
from sparkloom.operators import verification as C
from sparkloom.plans.registry import query
from sparkloom.plans.retrieve import _OVERLAP, _bm25_sql
from sparkloom.sources.tables import table


def _answers(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.lag("text").over(w).alias("evidence"))


_PAIRS = "p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations)"
_TK = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'))"
_HEDGED = " OR ".join(f"contains(lower(coalesce(answer, '')), '{h}')" for h in T.HEDGES)


@query(
    "verify_support",
    f"""WITH {_PAIRS}, t AS (SELECT *, {_TK.format('answer')} AS a, {_TK.format('evidence')} AS e FROM p), s AS (SELECT *, CASE WHEN len(a) = 0 OR len(e) = 0 THEN 0.0 ELSE len(list_intersect(a, e)) / len(a) END AS s FROM t)
    SELECT conv_id, turn, round(s, 8) AS support, s >= 0.22 OR {_HEDGED} AS grounded FROM s""",
)
def verify_support(spark, sf_dir):
    return C.unsupported(_answers(spark, sf_dir)).select("conv_id", "turn", F.round("support", 8).alias("support"), "grounded")


_NEG = " OR ".join(f"contains(lower(coalesce(text, '')), '{n.replace(chr(39), chr(39) * 2)}')" for n in C.NEGATIONS)
_STOPS = ", ".join(f"'{w}'" for w in C.SHORT_STOP)


@query(
    "verify_conflicts",
    f"""WITH k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_]{{4,}}')), lambda x: x NOT IN ({_STOPS})) AS w, ({_NEG}) AS n FROM conversations WHERE trim(coalesce(text, '')) <> ''),
    q AS (SELECT a.conv_id, len(list_intersect(a.w, b.w)) > 0 AND a.n <> b.n AS hit, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.i, b.i) AS p FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.i < b.i)
    SELECT conv_id, count(*) AS pairs_checked, count(*) FILTER (hit) AS conflict_hits, round(count(*) FILTER (hit) / count(*), 4) AS score, round(count(*) FILTER (hit) / count(*), 4) >= 0.25 AND count(*) FILTER (hit) > 0 AS conflict FROM q WHERE p <= 100 GROUP BY conv_id""",
)
def verify_conflicts(spark, sf_dir):
    return C.conflicts(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("verify_numbers")
def verify_numbers(spark, sf_dir):
    """Numbers and dates of a turn that the turn before lacks; list lambdas over lists have no plain SQL, so tests compare with Python."""
    out = C.unsupported(_answers(spark, sf_dir))
    return out.select("conv_id", "turn", F.size("missing_numbers").alias("numbers"), F.size("missing_dates").alias("dates"))


@query(
    "verify_evidence",
    """WITH e AS (SELECT event_id, event_id % 5 AS h, event_id % 4 AS n, event_id % 13 AS b, CASE event_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' WHEN 2 THEN 'hybrid' ELSE 'web' END AS route, 1 + event_id % 3 AS least FROM events),
    s AS (SELECT *, least(1.0, h / 3) AS v, least(1.0, n / 3 + b / 12) AS g, CASE WHEN least <= 1 THEN 0.33 WHEN least = 2 THEN 0.67 ELSE 1.0 END AS t FROM e),
    c AS (SELECT *, CASE route WHEN 'vector' THEN v WHEN 'graph' THEN g WHEN 'hybrid' THEN least(1.0, 0.7 * v + 0.3 * g) ELSE greatest(v, g) END AS score FROM s)
    SELECT event_id, round(score, 8) AS score, (route = 'hybrid' AND v + g >= t) OR score >= CASE WHEN route = 'hybrid' AND (v >= 0.67 OR g >= 0.67) THEN greatest(0.5, t - 0.2) ELSE t END AS enough FROM c""",
)
def verify_evidence(spark, sf_dir):
    i = F.col("event_id")
    route = F.when(i % 4 == 0, "vector").when(i % 4 == 1, "graph").when(i % 4 == 2, "hybrid").otherwise("web")
    args = (i % 5, i % 4, i % 13, route)
    return table(spark, sf_dir, "events").select("event_id", F.round(C.evidence_score(*args), 8).alias("score"), C.sufficient(*args, 1 + i % 3).alias("enough"))


@query(
    "verify_quality",
    """WITH p AS (SELECT event_id, (event_id % 11) / 10.0 AS r, (event_id % 7) / 6.0 AS t, (event_id % 13) / 12.0 AS a, (event_id % 5) / 4.0 AS c, (event_id % 3) / 2.0 AS l, (event_id % 17) / 16.0 AS risk FROM events),
    q AS (SELECT event_id, round((0.10 * r + 0.30 * t + 0.45 * a + 0.10 * c + 0.05 * l) * CASE WHEN risk > 0.30 THEN 0.7 ELSE 1.0 END * CASE WHEN r < 0.5 THEN 0.8 ELSE 1.0 END + 1e-9, 3) AS score, 0.40 * a + 0.25 * t + 0.25 * c + 0.10 * l AS d FROM p)
    SELECT event_id, score, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.70 THEN 'good' WHEN score >= 0.50 THEN 'fair' ELSE 'poor' END AS level, CASE WHEN d >= 0.80 THEN 'approve' WHEN d >= 0.60 THEN 'flag' ELSE 'regenerate' END AS action FROM q""",
)
def verify_quality(spark, sf_dir):
    i = F.col("event_id")
    part = {"routing": i % 11 / 10, "retrieval": i % 7 / 6, "answer": i % 13 / 12, "citation": i % 5 / 4, "latency": i % 3 / 2}
    score, level = C.quality(part, i % 17 / 16)
    _, action = C.decision(part["answer"], part["retrieval"], part["citation"], part["latency"])
    return table(spark, sf_dir, "events").select("event_id", score.alias("score"), level.alias("level"), action.alias("action"))


_SIDES = f"{_bm25_sql(k=10)}, {_OVERLAP}, bo AS (SELECT query, doc, score FROM bm UNION ALL SELECT query, doc, score FROM ov)"


def _sides(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = R.tokenised(docs)
    return R.bm25(docs, asked, 10, words=words), R.overlap_search(docs, asked, 10, words=words)


@query("merge_paths", f"WITH {_SIDES} SELECT query, doc, count(*) AS paths, round(max(score) * (1 + 0.2 * (count(*) - 1)), 5) AS boosted FROM bo GROUP BY ALL")
def merge_paths(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return M.by_paths(a.unionByName(b)).select("query", "doc", "paths", F.round("boosted", 5).alias("boosted"))


@query(
    "merge_votes",
    f"WITH {_SIDES}, v AS (SELECT query, doc, count(*) AS votes, least(1.0, round(max(score) / 1000, 8) + 0.1 * (count(*) - 1)) AS score FROM bo GROUP BY ALL) SELECT query, doc, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 8) DESC, doc) AS rank FROM v) WHERE rank <= 5",
)
def merge_votes(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return M.by_votes(a.unionByName(b).withColumn("score", F.round(F.col("score") / 1000, 8)), 5).select("query", "doc", "votes", "rank")


@query(
    "merge_min_max",
    f"""WITH {_SIDES}, sd AS (SELECT query, doc, score, 'a' AS side FROM bm UNION ALL SELECT query, doc, score, 'b' FROM ov), n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sd WINDOW w AS (PARTITION BY query, side))
    SELECT query, doc, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END * CASE WHEN side = 'a' THEN 0.7 ELSE 0.3 END), 5) AS score FROM n GROUP BY ALL""",
)
def merge_min_max(spark, sf_dir):
    return M.min_max(*_sides(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query("merge_over_best", f"WITH {_SIDES}, p AS (SELECT query, doc, 0.5 * score AS part FROM ov UNION ALL SELECT query, doc, score / max(score) OVER (PARTITION BY query) * 0.5 FROM bm) SELECT query, doc, round(sum(part), 5) AS score FROM p GROUP BY ALL")
def merge_over_best(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return M.over_best(b, a).withColumn("score", F.round("score", 5))


@query(
    "eval_must_contain",
    f"""WITH {_bm25_sql(k=5)}, c AS (SELECT item_id AS query, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')[1:3] AS m FROM benchmark), t AS (SELECT query, unnest(m) AS term FROM c),
    h AS (SELECT t.query, term, max(CAST(contains(lower(d.text), term) AS INT)) AS held FROM t LEFT JOIN bm USING (query) LEFT JOIN documents d ON d.doc_id = bm.doc GROUP BY ALL) SELECT query, min(coalesce(held, 0)) = 1 AS hit FROM h GROUP BY query""",
)
def eval_must_contain(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    cases = asked.select(F.col("item_id").alias("query"), F.slice(T.matches(F.lower(T.text("text")), "[a-z]+"), 1, 3).alias("must_contain"))
    found = R.bm25(docs, asked, 5).join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return M.must_contain(found, cases)


@query("text_normalised")
def text_normalised(spark, sf_dir):
    """Unicode normalisation and categories are in neither engine's SQL; tests/test_vectorised.py compares with plain Python."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(V.normalise("text"), F.lit(""))).alias("digest"))


@query("text_numbered_redaction")
def text_numbered_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(V.redact("text")).alias("digest"))


@query("text_hashed_embedding")
def text_hashed_embedding(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.transform(V.embed("text"), lambda x: F.round(x, 6)).alias("embedding"))


@query("structure_sections")
def structure_sections(spark, sf_dir):
    """Parents come from a stack that is kept line by line; tests compare with Python."""
    return S.sections(table(spark, sf_dir, "documents")).select("doc", "section", "level", "title", F.md5("content").alias("digest"), "parent")


@query("audit_filter", "SELECT event_id, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND contains(event_type, 'err') AND contains(lower(coalesce(props, '')), '7') ORDER BY ts DESC, event_id LIMIT 50")
def audit_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("detail"))
    return S.audit(rows, since="2024-01-05 00:00:00", action="err", keyword="7", limit=50).select("event_id", "created_at")


@query("access_visible", "SELECT doc_id FROM documents WHERE source = 'src3' OR lang = 'en'")
def access_visible(spark, sf_dir):
    public = F.when(F.col("lang") == "en", "public").otherwise("private")
    return table(spark, sf_dir, "documents").filter(S.visible("src3", False, F.col("source"), public)).select("doc_id")


@query("access_permitted", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN event_type IN ('view', 'click') ELSE false END AS allowed FROM events")
def access_permitted(spark, sf_dir):
    role = F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "viewer").otherwise("guest")
    grants = spark.createDataFrame([("admin", "*"), ("viewer", "view"), ("viewer", "click")], "role string, action string")
    return S.permitted(table(spark, sf_dir, "events").select("event_id", role.alias("role"), F.col("event_type").alias("action")), grants).select("event_id", "allowed")
