"""Operational analytics. `events` stands for request logs: `value` is a latency, an `error` event a failure, the user an actor."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "ops_overview",
    """SELECT count(*) AS total, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_value, count(DISTINCT user_id) AS actors,
    count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'purchase') AS purchases, min(ts) AS first_ts, max(ts) AS last_ts FROM events""",
)
def ops_overview(spark, sf_dir):
    t = F.col("event_type")
    return _events(spark, sf_dir).agg(
        F.count("*").alias("total"), F.round(100.0 * F.count_if(t != "error") / F.count("*"), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("avg_value"),
        F.countDistinct("user_id").alias("actors"), F.count_if(t == "signup").alias("signups"), F.count_if(t == "purchase").alias("purchases"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("ops_agent_stats", "SELECT user_id % 7 AS agent, count(*) AS n, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_value, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS avg_top FROM events GROUP BY 1")
def ops_agent_stats(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("agent"))
    return rows.agg(
        F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("avg_value"),
        F.round(F.coalesce(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 6).alias("avg_top"),
    )


@query("ops_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def ops_hourly(spark, sf_dir):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00").alias("hour")
    return _events(spark, sf_dir).groupBy(hour).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("ops_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ops_daily(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


_MARKS = {"p95_floor_n1": ("floor_n1", 0.95), "p50_floor_n": ("floor_n", 0.5), "p99_floor_n": ("floor_n", 0.99), "p95_less": ("floor_n_less", 0.95), "p95_exclusive": ("exclusive", 0.95), "median": ("median", 0.5)}


@query(
    "ops_percentiles",
    """WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(x) FILTER (i = floor(0.95 * (n - 1))) AS p95_floor_n1, max(x) FILTER (i = least(floor(0.5 * n), n - 1)) AS p50_floor_n, max(x) FILTER (i = least(floor(0.99 * n), n - 1)) AS p99_floor_n,
    max(x) FILTER (i = greatest(0, floor(0.95 * n) - 1)) AS p95_less, round(CASE WHEN max(n) < 20 THEN max(x) ELSE max(x) FILTER (i = greatest(1, least(n - 1, floor(0.95 * (n + 1)))) - 1)
      + max(0.95 * (n + 1) - greatest(1, least(n - 1, floor(0.95 * (n + 1))))) * (max(x) FILTER (i = greatest(1, least(n - 1, floor(0.95 * (n + 1))))) - max(x) FILTER (i = greatest(1, least(n - 1, floor(0.95 * (n + 1)))) - 1)) END, 6) AS p95_exclusive,
    round(median(x), 6) AS median FROM r GROUP BY event_type""",
)
def ops_percentiles(spark, sf_dir):
    out = A.percentiles(_events(spark, sf_dir), ["event_type"], "value", _MARKS)
    return out.withColumns({c: F.round(c, 6) for c in ("p95_exclusive", "median")})


@query("ops_top_users", "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8")
def ops_top_users(spark, sf_dir):
    return A.top_counts(_events(spark, sf_dir), "user_id", 8)


@query("ops_slowest", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def ops_slowest(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.desc_nulls_last("value"), "event_id").limit(10).select("event_id", "value")


@query(
    "ops_alerts",
    """WITH r AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
    k AS (SELECT (SELECT max(x) FILTER (i = greatest(0, floor(0.95 * n) - 1)) FROM r) AS p95, (SELECT 100.0 * count(*) FILTER (event_type = 'error') / count(*) FROM events) AS error_rate)
    SELECT alert, round(v, 6) AS value FROM (SELECT 'latency' AS alert, p95 AS v, 50.0 AS lim FROM k UNION ALL SELECT 'errors', error_rate, 5.0 FROM k) WHERE v > lim""",
)
def ops_alerts(spark, sf_dir):
    rows = _events(spark, sf_dir)
    errors = rows.agg((100.0 * F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"))
    p95 = _p95(rows)
    both = errors.crossJoin(p95)  # one row each
    checks = F.array(F.struct(F.lit("latency").alias("alert"), F.col("p95").alias("v"), F.lit(50.0).alias("lim")), F.struct(F.lit("errors").alias("alert"), F.col("error_rate").alias("v"), F.lit(5.0).alias("lim")))
    return both.select(F.explode(F.filter(checks, lambda c: c["v"] > c["lim"])).alias("c")).select("c.alert", F.round("c.v", 6).alias("value"))


def _p95(rows):
    """The 95th percentile of the ops report without a window over all rows: the value at a place, found from counts of values."""
    counts = rows.filter("value is not null").groupBy("value").agg(F.count("*").alias("c"))
    edges = counts.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("c").alias("n"))
    cells = counts.crossJoin(F.broadcast(edges)).withColumn("cell", F.floor((F.col("value") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * 4095))
    tops = cells.groupBy("cell").agg(F.sum("c").alias("c"))  # at most 4096 rows
    before = tops.withColumn("before", F.sum("c").over(Window.orderBy("cell")) - F.col("c"))
    place = F.greatest(F.lit(0), F.floor(0.95 * F.col("n")) - 1)
    hit = cells.join(F.broadcast(before.select("cell", "before", F.col("c").alias("in_cell"))), "cell").filter((place >= F.col("before")) & (place < F.col("before") + F.col("in_cell")))
    run = F.sum("c").over(Window.partitionBy("cell").orderBy("value")) + F.col("before")
    return hit.withColumn("run", run).filter(F.col("run") > place).agg(F.min("value").alias("p95"))


@query("ops_document_usage", "SELECT l_suppkey AS source, count(*) AS uses, round(avg(CASE WHEN l_linenumber <= 3 THEN l_extendedprice END), 4) AS avg_score, count(DISTINCT l_returnflag) AS agents FROM lineitem GROUP BY 1")
def ops_document_usage(spark, sf_dir):
    """Per source: uses, the mean score of uses within the first three places, and the number of classes that use it."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"))
    return rows.agg(F.count("*").alias("uses"), F.round(F.avg(F.when(F.col("l_linenumber") <= 3, F.col("l_extendedprice"))), 4).alias("avg_score"), F.countDistinct("l_returnflag").alias("agents"))


@query("ops_class_rollup", "SELECT coalesce(lang, '未分类') AS class, count(DISTINCT source) AS sources, count(*) AS chunks, string_agg(DISTINCT source, ',' ORDER BY source) AS list FROM documents GROUP BY 1")
def ops_class_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("未分类")).alias("class"))
    return rows.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("list"))


@query("ops_compare", "WITH m AS (SELECT event_type, avg(value) AS v, count(*) AS n FROM events GROUP BY 1), b AS (SELECT v, n FROM m WHERE event_type = 'view') SELECT event_type, round(m.v - b.v, 6) AS delta, m.n - b.n AS n_delta FROM m, b")
def ops_compare(spark, sf_dir):
    means = _events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    base = means.filter("event_type = 'view'").select(F.col("v").alias("bv"), F.col("n").alias("bn"))
    return means.crossJoin(F.broadcast(base)).select("event_type", F.round(F.col("v") - F.col("bv"), 6).alias("delta"), (F.col("n") - F.col("bn")).alias("n_delta"))


@query(
    "ops_calibration",
    """WITH p AS (SELECT event_id, 0.5 + (event_id % 50) / 100.0 AS c, CAST(event_type <> 'error' AS INT) AS ok FROM events), b AS (SELECT *, CAST(least(4, floor((c - 0.5) * 10 + 1e-9)) AS INT) AS bucket FROM p),
    s AS (SELECT bucket, count(*) AS n, avg(ok) AS accuracy FROM b GROUP BY 1) SELECT event_id, bucket, round(CASE WHEN n >= 5 THEN greatest(0.0, least(1.0, c * accuracy / (0.55 + 0.1 * bucket))) ELSE c END, 6) AS calibrated FROM b JOIN s USING (bucket)""",
)
def ops_calibration(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (0.5 + (F.col("event_id") % 50) / 100).alias("c"), (F.col("event_type") != "error").cast("int").alias("ok"))
    return A.calibrated(rows, "c", "ok").select("event_id", "bucket", F.round("calibrated", 6).alias("calibrated"))


@query("ops_json_properties", "SELECT CAST(props->>'k' AS BIGINT) % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ops_json_properties(spark, sf_dir):
    bucket = (F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")
    return _events(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("log_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 5")
def log_last_n(spark, sf_dir):
    return A.last_n(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("log_majority", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 5), c AS (SELECT user_id, event_type, count(*) AS n, min(p) AS first FROM l GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1")
def log_majority(spark, sf_dir):
    """The most frequent type among each user's last five events; of equal ones the latest."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    five = _events(spark, sf_dir).withColumn("p", F.row_number().over(w)).filter("p <= 5")
    counts = five.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))).filter("r = 1").select("user_id", "event_type", "n")


@query("log_topic_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def log_topic_changes(spark, sf_dir):
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).withColumn("prev", prev).filter("prev is null or prev <> event_type").select("user_id", "event_id", "event_type")


@query(
    "log_answer_pairs",
    """WITH p AS (SELECT *, lag(role) OVER w AS lr, lag(text) OVER w AS q, lag(turn) OVER w AS lt FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    a AS (SELECT conv_id, lt AS question_turn, turn AS answer_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM p WHERE role = 'assistant' AND lr = 'user') SELECT conv_id, question_turn, answer_turn, r <= 3 AS in_context FROM a""",
)
def log_answer_pairs(spark, sf_dir):
    """Rounds of question and answer, and whether a round is among the last three of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant') and trim(coalesce(text, '')) <> ''")
    pairs = turns.withColumns({"lr": F.lag("role").over(w), "question_turn": F.lag("turn").over(w)}).filter("role = 'assistant' and lr = 'user'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return pairs.select("conv_id", "question_turn", F.col("turn").alias("answer_turn"), (place <= 3).alias("in_context"))


@query(
    "log_memory_ranking",
    """WITH s AS (SELECT conv_id, turn, round(0.35 * least(turn, 3) / 3 + 0.30 * least(turn % 5, 4) / 4 + 0.20 * CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END + 0.15 * least(length(trim(coalesce(text, ''))), 600) / 600, 6) AS score FROM conversations WHERE role = 'assistant'),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM s) WHERE p <= 20) SELECT conv_id, turn, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS r FROM w) WHERE r <= 5""",
)
def log_memory_ranking(spark, sf_dir):
    """Each conversation's five best answers among its last twenty."""
    turn = F.col("turn")
    score = 0.35 * F.least(turn, F.lit(3)) / 3 + 0.30 * F.least(turn % 5, F.lit(4)) / 4 + 0.20 * F.when(turn % 2 == 0, 0).otherwise(1) + 0.15 * F.least(F.length(F.trim(F.coalesce("text", F.lit("")))), F.lit(600)) / 600
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.round(score, 6).alias("score"))
    recent = A.last_n(rows, ["conv_id"], [F.desc("turn")], 20)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("turn")))
    return recent.withColumn("rank", place).filter("rank <= 5")
