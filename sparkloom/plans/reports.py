"""Queries of reports, as-of and interval joins, scopes, index upkeep and prepared questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.operators import ordered
from sparkloom.operators import reports as R
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "report_index_health",
    """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'indexing' ELSE 'failed' END AS s, o_custkey AS c, o_orderkey % 5 AS t FROM orders)
    SELECT count(*) AS total, count(*) FILTER (s = 'ready') AS ready, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IN ('pending', 'indexing')) AS indexing, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(t) AS BIGINT) AS triplets FROM r""",
)
def report_index_health(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "indexing").otherwise("failed")
    return R.health(table(spark, sf_dir, "orders").select(status.alias("s"), "o_custkey", (F.col("o_orderkey") % 5).alias("t")), "s", "o_custkey", "t")


@query(
    "report_processing",
    """SELECT count(*) AS total, round(avg(value), 6) AS avg_seconds, round(avg(CAST(event_type = 'view' AS INT)), 6) AS hit_rate, CAST(sum(user_id % 4) AS BIGINT) AS calls, round(sum(user_id % 4) * 0.01, 6) AS cost,
    round(avg(CAST(event_type = 'error' AS INT)), 6) AS error_rate FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
)
def report_processing(spark, sf_dir):
    rows = _events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("end"))))  # one row
    return R.processing(rows, "ts", F.col("end"), 7, F.col("value"), F.col("event_type") == "view", F.col("user_id") % 4, F.col("event_type") == "error")


@query(
    "report_load",
    """SELECT count(*) AS requests, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors,
    round(count(*) / greatest(0.0001, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6), 6) AS rps, round(avg(value), 6) AS avg_latency FROM events""",
)
def report_load(spark, sf_dir):
    return R.load(_events(spark, sf_dir), "ts", "value", F.col("event_type") != "error")


@query("report_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def report_status_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query(
    "report_queries",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, CASE WHEN value < 50 THEN 'fast' WHEN value < 150 THEN 'balanced' ELSE 'deep' END AS tier, count(*) AS n,
    round(100.0 * count(*) FILTER (user_id % 3 = 0) / count(*), 6) AS cache_hit_rate, round(avg(value), 6) AS avg_latency FROM events GROUP BY ALL""",
)
def report_queries(spark, sf_dir):
    v = F.col("value")
    tier = F.when(v < 50, "fast").when(v < 150, "balanced").otherwise("deep")
    rows = _events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind"), tier.alias("tier"))
    return rows.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("user_id") % 3 == 0) / F.count("*"), 6).alias("cache_hit_rate"), F.round(F.avg("value"), 6).alias("avg_latency"))


@query("report_cache", "SELECT user_id AS cache, count(*) AS size, count(*) FILTER (event_type = 'view') AS hits, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def report_cache(spark, sf_dir):
    hits = F.count_if(F.col("event_type") == "view")
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("cache")).agg(F.count("*").alias("size"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("hit_rate"))


@query("report_most_chunks", "SELECT lower(source) AS filename, max(n_chars) AS chunks FROM documents GROUP BY 1")
def report_most_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.lower("source").alias("filename")).agg(F.max("n_chars").alias("chunks"))


@query(
    "report_fingerprint",
    f"""WITH r AS (SELECT source, md5({" || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "lang", "n_chars"))}) AS m FROM documents)
    SELECT source, sha256(count(*) || {" || ".join(f"'|' || CAST(sum(CAST('0x' || substr(m, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT)" for i in range(4))}) AS fingerprint FROM r GROUP BY 1""",
)
def report_fingerprint(spark, sf_dir):
    return R.fingerprint(table(spark, sf_dir, "documents"), "source", ["doc_id", "lang", "n_chars"])


@query("report_session_languages", "SELECT conv_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]', '', 'g')) = 0 THEN 'zh' ELSE 'en' END AS lang, count(*) AS n, count(*) FILTER (role = 'user') AS forced, count(*) FILTER (role <> 'user') AS auto FROM conversations GROUP BY ALL")
def report_session_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", T.language("text").alias("lang"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("forced"), F.count_if(F.col("role") != "user").alias("auto"))


@query("report_recent_traces", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def report_recent_traces(spark, sf_dir):
    """The limit is the report: the 50 last traces."""
    return _events(spark, sf_dir).select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query("report_sessions", "SELECT user_id, max(ts) AS updated_at, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1 ORDER BY updated_at DESC, user_id")
def report_sessions(spark, sf_dir):
    """Sessions, the last used first."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).orderBy(F.desc("updated_at"), "user_id")


@query("report_files", "SELECT regexp_extract(url, '[^/]*$') AS filename, url AS source, row_number() OVER (ORDER BY lower(regexp_extract(url, '[^/]*$')), lower(url), page_id) AS place FROM pages")
def report_files(spark, sf_dir):
    """The list of files by name and source, with the place of each. The list is cut by the names' first two letters, not sorted in one task."""
    name = F.substring_index("url", "/", -1)
    rows = table(spark, sf_dir, "pages").select(name.alias("filename"), F.col("url").alias("source"), F.lower(name).alias("_name"), F.lower("url").alias("_source"), "page_id")
    placed = ordered.numbered(rows, [], ["_name", "_source", "page_id"], F.substring("_name", 1, 2))
    return placed.select("filename", "source", "place")


@query("report_window", "SELECT least(168, greatest(1, 500)) AS hours, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR")
def report_window(spark, sf_dir):
    """A window of 500 hours is asked for; 1 to 168 are given."""
    hours = F.least(F.lit(168), F.greatest(F.lit(1), F.lit(500)))
    rows = _events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("end"))))  # one row
    recent = rows.filter(F.col("ts") >= F.col("end") - F.make_interval(hours=hours))
    return recent.agg(F.first(hours).alias("hours"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    "join_as_of",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, p.user_id, p.ts, v.value AS value_as_of FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def join_as_of(spark, sf_dir):
    """Each purchase with the value of the user's last view before it."""
    rows = _events(spark, sf_dir)
    return R.as_of(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), rows.filter("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", ["value"], F.date_trunc("day", "ts"))


@query(
    "join_interval",
    """WITH b AS (SELECT p_partkey AS bucket, p_partkey * 2.5 AS low, p_partkey * 2.5 + 2.5 * (1 + p_partkey % 7) AS high FROM part)
    SELECT bucket, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN b ON value >= low AND value < high GROUP BY 1""",
)
def join_interval(spark, sf_dir):
    """Values by overlapping buckets of seven lengths, one for each part."""
    key = F.col("p_partkey")
    buckets = table(spark, sf_dir, "part").select(key.alias("bucket"), (key * 2.5).alias("low"), (key * 2.5 + 2.5 * (1 + key % 7)).alias("high"))
    met = R.in_interval(_events(spark, sf_dir), "value", buckets, "low", "high", 2.5)
    return met.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "scope_enforced",
    """WITH a AS (SELECT DISTINCT 'src' || n_nationkey AS source FROM nation WHERE n_regionkey IN (0, 1)) SELECT lang, count(*) FILTER (a.source IS NOT NULL) AS kept, count(*) FILTER (a.source IS NULL) AS denied FROM documents d LEFT JOIN a ON d.source = a.source GROUP BY 1""",
)
def scope_enforced(spark, sf_dir):
    allowed = table(spark, sf_dir, "nation").filter("n_regionkey in (0, 1)").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    rows = R.in_scope(table(spark, sf_dir, "documents"), "source", allowed)
    return rows.groupBy("lang").agg(F.count_if("in_scope").alias("kept"), F.count_if(~F.col("in_scope")).alias("denied"))


@query("scope_sources", "SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey IN (0, 1))")
def scope_sources(spark, sf_dir):
    """Sources of a class that are allowed too."""
    of_class = table(spark, sf_dir, "documents").filter("lang = 'en'").select("source")
    return of_class.intersect(table(spark, sf_dir, "nation").filter("n_regionkey in (0, 1)").select(F.concat(F.lit("src"), "n_nationkey").alias("source")))


@query("scope_fresh", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AND o_orderstatus = 'F'")
def scope_fresh(spark, sf_dir):
    """Documents that need no new indexing: ready, and the stored digest is that of the file (here: the customer's balance is above 0)."""
    same = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").join(same, "o_custkey", "left_semi").select("o_orderkey")


@query("index_without_sources", "SELECT source, count(*) AS n FROM documents WHERE source IS NULL OR source NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1")
def index_without_sources(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return R.without(table(spark, sf_dir, "documents"), gone, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("index_overridden", "SELECT doc_id, coalesce(n_name, lang) AS lang FROM documents LEFT JOIN nation ON source = 'src' || n_nationkey")
def index_overridden(spark, sf_dir):
    other = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("source"), F.col("n_name").alias("lang"))
    return R.overridden(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), other, "source", ["lang"]).select("doc_id", "lang")


@query(
    "log_memory_fallback",
    """WITH h AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND value > 150), m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
    SELECT user_id, event_id, false AS fallback FROM h UNION ALL SELECT user_id, event_id, true FROM m WHERE k <= 2 AND user_id NOT IN (SELECT user_id FROM h)""",
)
def log_memory_fallback(spark, sf_dir):
    rows = _events(spark, sf_dir)
    hits = rows.filter("event_type = 'purchase' and value > 150").select("user_id", "event_id")
    return R.or_most_recent(hits, rows.select("user_id").distinct(), rows.select("user_id", "event_id"), "user_id", "event_id")


@query("hash_cache_key", """SELECT item_id, sha256('{"a": "general", "q": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ', "s": ' || item_id % 7 || ', "u": ' || CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'null' END || '}') AS key FROM benchmark""")
def hash_cache_key(spark, sf_dir):
    key = R.cache_key({"q": T.text("text"), "s": F.col("item_id") % 7, "a": F.lit("general"), "u": F.when(F.col("item_id") % 2 == 0, True)})
    return table(spark, sf_dir, "benchmark").select("item_id", key.alias("key"))


_STOP = ["the", "and", "is", "of", "in"]
_SYNONYMS = {"the": ["this", "that", "a"], "of": ["from"], "and": ["plus", "also"]}
_WORDS = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), ' ')"


@query("question_stop_words", f"WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark), k AS (SELECT item_id, w, list_filter(w, lambda x: x NOT IN ('the', 'and', 'is', 'of', 'in')) AS k FROM w) SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w[1:1] END, ' ') AS words FROM k")
def question_stop_words(spark, sf_dir):
    words = Q.without_stop_words(F.split(Q.plain(F.lower("text")), " "), _STOP)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


@query(
    "question_synonyms",
    f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark)
    SELECT item_id, array_to_string(list_transform(w, lambda x: CASE x WHEN 'the' THEN '(the OR a OR that)' WHEN 'of' THEN '(of OR from)' WHEN 'and' THEN '(and OR also OR plus)' ELSE x END), ' ') AS query FROM w""",
)
def question_synonyms(spark, sf_dir):
    _, groups = Q.with_synonyms(F.split(Q.plain(F.lower("text")), " "), _SYNONYMS)
    return table(spark, sf_dir, "benchmark").select("item_id", groups.alias("query"))


@query("question_aliases", f"WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark) SELECT item_id, array_to_string(list_transform(w, lambda x: CASE x WHEN 'the' THEN 'a' WHEN 'of' THEN 'from' ELSE x END), ' ') AS words FROM w")
def question_aliases(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(Q.mapped(F.split(Q.plain("text"), " "), {"the": "a", "of": "from"}), " ").alias("words"))


@query(
    "question_entities",
    """WITH e AS (SELECT item_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+') || regexp_extract_all(coalesce(text, ''), '[a-z]{8,}')) AS e FROM benchmark), u AS (SELECT item_id, unnest(e) AS e FROM e)
    SELECT b.item_id, coalesce(string_agg(e, ' ' ORDER BY length(e) DESC, e), '') AS entities FROM benchmark b LEFT JOIN u ON u.item_id = b.item_id GROUP BY 1""",
)
def question_entities(spark, sf_dir):
    found = Q.merged(T.matches("text", "[A-Z][a-z]+"), T.matches("text", "[a-z]{8,}"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(found, " ").alias("entities"))


@query(
    "question_plan",
    """WITH l AS (SELECT user_id, CASE WHEN value < 50 THEN 'simple' WHEN value < 150 THEN 'medium' ELSE 'complex' END AS level, CASE event_type WHEN 'view' THEN 'graph' WHEN 'click' THEN 'vector' ELSE event_type END AS r, event_id, event_type = 'error' AS web FROM events),
    c AS (SELECT *, CASE WHEN level = 'complex' AND (r = 'vector' OR r NOT IN ('graph', 'hybrid', 'react')) THEN 'hybrid' WHEN r IN ('vector', 'graph', 'hybrid', 'react') THEN r ELSE 'vector' END AS route FROM l)
    SELECT event_id, route, CASE level WHEN 'simple' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS least_hits, route IN ('graph', 'hybrid') AS graph, web FROM c""",
)
def question_plan(spark, sf_dir):
    v, kind = F.col("value"), F.col("event_type")
    level = F.when(v < 50, "simple").when(v < 150, "medium").otherwise("complex")
    route, least, graph, web = Q.plan(level, F.when(kind == "view", "graph").when(kind == "click", "vector").otherwise(kind), kind == "error")
    return _events(spark, sf_dir).select("event_id", route.alias("route"), least.alias("least_hits"), graph.alias("graph"), web.alias("web"))


@query("question_relation_weights", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 WHEN contains(event_type, 'ic') OR contains(event_type, 'view') THEN 1.0 ELSE 0.6 END AS weight FROM events")
def question_relation_weights(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Q.relation_weight("event_type", ["error"], ["ic", "view"]).alias("weight"))


@query(
    "question_judged",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(1.0, greatest(0.0, value / 100)) END AS score, CASE event_type WHEN 'view' THEN 'highly_relevant' WHEN 'click' THEN 'somewhat_relevant' ELSE 'not_relevant' END AS label,
    CASE WHEN event_type = 'signup' THEN 'Unable to parse response' ELSE 'user ' || user_id END AS reason FROM events""",
)
def question_judged(spark, sf_dir):
    kind = F.col("event_type")
    number = F.when(kind == "error", "none").otherwise((F.col("value") / 100).cast("string"))
    label = F.when(kind == "view", "Highly_Relevant").when(kind == "click", "somewhat_relevant").otherwise(kind)
    reason = F.when(kind == "signup", "").otherwise(F.concat(F.lit("\nREASONING: user "), F.col("user_id").cast("string")))
    score, found, why = Q.judged(F.concat(F.lit("SCORE: "), number, F.lit("\n  LABEL: "), label, reason))
    return _events(spark, sf_dir).select("event_id", score.alias("score"), found.alias("label"), why.alias("reason"))
