"""Queries with rules over questions, answers and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import rules as U
from sparkloom.functions import text as T
from sparkloom.operators import retrieval as R
from sparkloom.plans.registry import query
from sparkloom.plans.retrieve import _candidates
from sparkloom.sources.tables import table


def _edges(pattern: str) -> str:
    """Word boundaries that know all letters, for an engine whose own know ASCII."""
    return pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")


_X = "coalesce(text, '')"
_SIM = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'))"
_MARKS = f"(length({_X}) - length(translate({_X}, '?？', '')))"


@query(
    "rules_questions",
    f"""WITH s AS (SELECT conv_id, turn, {_X} AS t, lower(trim({_X})) AS q, {_SIM.format(_X)} AS n FROM conversations), g AS (SELECT *, least(2, CAST(n >= 28 AS INT) + CAST(regexp_matches(t, '{U.HINTS}') AS INT) + CAST(length(t) - length(translate(t, '?？', '')) >= 2 AS INT)) AS scale FROM s)
    SELECT conv_id, turn, (regexp_matches(t, '{U.DANGER}') AND regexp_matches(t, '{U.ACTION}')) OR regexp_matches(t, '{U.INJECTION}') AS blocked,
    length(t) <= 12 OR (length(t) <= 24 AND len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9_]+')) <= 3) OR regexp_matches(t, '{U.REFERENCE}') AS incomplete,
    CASE WHEN q = '' THEN 'simple' WHEN regexp_matches(q, '{_edges(U.POLICY_COMPLEX)}') THEN 'complex' WHEN regexp_matches(q, '{_edges(U.POLICY_MEDIUM)}') THEN 'medium' WHEN n >= 28 THEN 'complex' WHEN n >= 15 THEN 'medium' ELSE 'simple' END AS level,
    CASE WHEN scale > 0 THEN least(16, 6 + 2 * scale) ELSE 6 END AS top_k, CASE WHEN scale > 0 THEN least(10, 5 + scale) ELSE 5 END AS top_n,
    CASE WHEN regexp_matches(t, '{_edges(U.REAL_TIME)}') THEN 0 WHEN conv_id % 5 = 0 THEN 180 WHEN turn % 3 = 0 THEN 300 WHEN turn % 3 = 1 THEN 60 ELSE 120 END AS cache_seconds FROM g""",
)
def rules_questions(spark, sf_dir):
    k, n = U.retrieval_sizes("text")
    tier = F.when(F.col("turn") % 3 == 0, "FAST").when(F.col("turn") % 3 == 1, "deep")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", U.blocked("text").alias("blocked"), U.incomplete("text").alias("incomplete"), U.policy_level("text").alias("level"), k.alias("top_k"), n.alias("top_n"), U.cache_seconds("text", tier, F.col("conv_id") % 5 == 0).alias("cache_seconds")
    )


@query("rules_parts", f"WITH p AS (SELECT item_id, list_filter(list_transform(string_split_regex(trim({_X}), '{_edges(U.SPLIT_QUESTION)}'), lambda x: trim(x)), lambda x: length(x) >= 4) AS p, trim({_X}) AS q FROM benchmark) SELECT item_id, len(list_filter(p, lambda x: lower(x) <> lower(q))[1:3]) AS n FROM p")
def rules_parts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(U.parts("text")).cast("long").alias("n"))


@query("rules_rewrites")
def rules_rewrites(spark, sf_dir):
    """One row per rewriting of a passage; order and choice of words are those of text_query_keywords, which has SQL."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(U.rewrites("text")).alias("variant", "query"))


@query("rules_claims")
def rules_claims(spark, sf_dir):
    """Claims with citations and kind; nested lists of patterns have no plain SQL, so tests compare by hand."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(U.claims("text")).alias("i", "c"))
    return rows.select("conv_id", "turn", "i", F.md5("c.text").alias("digest"), F.size("c.citations").alias("citations"), "c.kind")


@query("rules_compressed")
def rules_compressed(spark, sf_dir):
    """The ranked documents of each query cut to the sentences that its words favour, within one budget for all of them; each stop is a fold."""
    found = R.rerank_lexical(_candidates(spark, sf_dir), 1000).select("query", "query_text", "rank", F.struct(F.col("doc").cast("long").alias("doc"), T.sentences("text").alias("sentences")).alias("d"))
    asked = found.groupBy("query").agg(F.first("query_text").alias("query_text"), F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("docs"))
    kept = U.compressed_in_turn(F.transform("docs", lambda x: x["d"]), F.array_distinct(T.tokens("query_text")))
    return asked.select(F.col("query").alias("item_id"), F.explode(kept).alias("k")).select("item_id", F.col("k.doc").alias("doc_id"), F.md5("k.text").alias("digest"))


@query(
    "rules_audit",
    """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Auth.login' WHEN 1 THEN 'query.run' WHEN 2 THEN 'document.add' WHEN 3 THEN 'admin.set' WHEN 4 THEN 'prompt.new' ELSE 'x' END AS action, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'denied' ELSE 'ok' END AS result, 'grounding_support=' || CAST(event_id % 30 AS VARCHAR) || '.5 x' AS d FROM events)
    SELECT event_id, CASE WHEN starts_with(lower(action), 'auth.') THEN 'auth' WHEN starts_with(lower(action), 'query.') OR starts_with(lower(action), 'document.') THEN 'data' WHEN starts_with(lower(action), 'admin.') THEN 'admin' WHEN starts_with(lower(action), 'prompt.') THEN 'prompt' ELSE 'system' END AS category,
    CASE result WHEN 'failed' THEN 'high' WHEN 'denied' THEN 'medium' ELSE 'info' END AS severity, greatest(0.0, least(1.0, CAST(regexp_extract(d, 'grounding_support=([0-9]*\\.?[0-9]+)', 1) AS DOUBLE))) AS grounding FROM a""",
)
def rules_audit(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    action = F.element_at(F.array(*map(F.lit, ["Auth.login", "query.run", "document.add", "admin.set", "prompt.new", "x"])), (i % 6 + 1).cast("int"))
    category, severity = U.audit_class(action, F.when(kind == "error", "failed").when(kind == "view", "denied").otherwise("ok"))
    return table(spark, sf_dir, "events").select("event_id", category.alias("category"), severity.alias("severity"), U.grounding(F.concat(F.lit("grounding_support="), i % 30, F.lit(".5 x"))).alias("grounding"))


@query(
    "log_recalibration",
    """WITH p AS (SELECT event_id, 0.5 + (event_id % 50) / 100.0 AS c, CAST(event_type <> 'error' AS INT) AS ok FROM events), g AS (SELECT CAST(round(c * 100) AS INT) AS k, count(*) AS n, sum(ok) AS good FROM p GROUP BY 1),
    b AS (SELECT a.k, sum(b.n) AS n, sum(b.good) AS good FROM g a JOIN g b ON abs(a.k - b.k) <= 7 GROUP BY a.k) SELECT event_id, round(CASE WHEN n >= 5 THEN 0.7 * good / n + 0.3 * c ELSE c END, 6) AS confidence FROM p JOIN b ON b.k = CAST(round(c * 100) AS INT)""",
)
def log_recalibration(spark, sf_dir):
    """Confidence drawn towards the accuracy of decisions within 0.075 of it. Decisions are counted by hundredth first, so the band join has at most 101 rows a side."""
    rows = table(spark, sf_dir, "events").select("event_id", (0.5 + (F.col("event_id") % 50) / 100).alias("c"), (F.col("event_type") != "error").cast("int").alias("ok")).withColumn("k", F.round(F.col("c") * 100).cast("int"))
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("ok").alias("good"))
    near = sums.select(F.explode(F.sequence(F.col("k") - 7, F.col("k") + 7)).alias("k"), "n", "good").groupBy("k").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    return rows.join(near, "k").select("event_id", F.round(F.when(F.col("n") >= 5, 0.7 * F.col("good") / F.col("n") + 0.3 * F.col("c")).otherwise(F.col("c")), 6).alias("confidence"))


@query("log_languages", "WITH l AS (SELECT conv_id, turn, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]', '', 'g')) = 0 THEN 'zh' ELSE 'en' END AS lang FROM conversations) SELECT lang, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM l GROUP BY lang")
def log_languages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(T.language("text").alias("lang")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions"))


@query(
    "index_rollup",
    "SELECT source, count(*) AS chunks, string_agg(DISTINCT CAST(n_chars % 5 AS VARCHAR), ',' ORDER BY CAST(n_chars % 5 AS VARCHAR)) AS pages, arg_max(lang, doc_id) FILTER (lang <> '') AS lang, count(*) FILTER (n_chars > 2000) AS long_chunks, sum(n_chars) AS n_chars FROM documents GROUP BY source",
)
def index_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source")
    return rows.agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set((F.col("n_chars") % 5).cast("string"))), ",").alias("pages"), F.max_by(F.when(F.col("lang") != "", F.col("lang")), F.when(F.col("lang") != "", F.col("doc_id"))).alias("lang"), F.count_if(F.col("n_chars") > 2000).alias("long_chunks"), F.sum("n_chars").alias("n_chars"))


@query("index_basename", "SELECT regexp_extract(url, '[^/]*$') AS name, count(DISTINCT url) AS sources, min(page_id) AS first FROM pages GROUP BY 1")
def index_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.substring_index("url", "/", -1).alias("name")).agg(F.countDistinct("url").alias("sources"), F.min("page_id").alias("first"))


@query(
    "eval_grid",
    """WITH g AS (SELECT unnest([1, 2, 3]) AS pos, unnest([0.3, 0.5, 0.7]) AS threshold), s AS (SELECT pos, threshold, round(avg(CAST(value / 100 >= threshold AS INT) * CAST(event_type <> 'error' AS INT)), 8) AS score FROM g, events GROUP BY ALL)
    SELECT threshold, score FROM s ORDER BY score DESC, pos LIMIT 1""",
)
def eval_grid(spark, sf_dir):
    """The first of the best settings."""
    grid = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.7)], "pos int, threshold double")
    hit = (F.col("value") / 100 >= F.col("threshold")).cast("int") * (F.col("event_type") != "error").cast("int")
    rows = table(spark, sf_dir, "events").crossJoin(F.broadcast(grid)).groupBy("pos", "threshold").agg(F.round(F.avg(hit), 8).alias("score"))
    return rows.orderBy(F.desc("score"), "pos").limit(1).select("threshold", "score")


@query("eval_cited", "WITH c AS (SELECT l_orderkey AS answer, l_partkey AS doc, l_linenumber AS page FROM lineitem), d AS (SELECT p_partkey AS doc, 1 + p_partkey % 3 AS page FROM part) SELECT answer, count(*) AS citations, round(count(d.doc) / count(*), 8) AS valid FROM c LEFT JOIN d ON c.doc = d.doc AND c.page = d.page GROUP BY answer")
def eval_cited(spark, sf_dir):
    """Share of an answer's citations whose document and page exist."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"))
    there = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), (1 + F.col("p_partkey") % 3).alias("page"), F.lit(1).alias("ok"))
    return cited.join(there, ["doc", "page"], "left").groupBy("answer").agg(F.count("*").alias("citations"), F.round(F.count("ok") / F.count("*"), 8).alias("valid"))


@query("log_expired", "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def log_expired(spark, sf_dir):
    """Contexts that nobody has used for twelve hours before the end of the log."""
    rows = table(spark, sf_dir, "events")
    end = rows.agg(F.max("ts").alias("end"))
    return rows.groupBy("user_id").agg(F.max("ts").alias("last_ts")).crossJoin(F.broadcast(end)).filter(F.col("last_ts") < F.col("end") - F.expr("INTERVAL 12 HOURS")).drop("end")


@query("log_single_flight", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS p FROM events) WHERE p = 1")
def log_single_flight(spark, sf_dir):
    """Of identical requests within an hour the first; a stream does the same with dropDuplicatesWithinWatermark."""
    w = Window.partitionBy("user_id", "event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("p", F.row_number().over(w)).filter("p = 1").select("event_id")
