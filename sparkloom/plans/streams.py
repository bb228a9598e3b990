"""Keyed state and event-time windows over `events`, as batches; the tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import table
from sparkloom.streaming import limits as L


def _timed(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") != "error").alias("ok"))


@query("stream_limiter")
def stream_limiter(spark, sf_dir):
    """At most 3 accepted events of a user in 6 hours. The decision feeds the state, so there is no SQL."""
    return L.decided(_timed(spark, sf_dir), "user_id", ["t", "event_id"], lambda: L.SlidingWindow(3, 6 * 3600), "allowed boolean, remaining int, reset_at double").select("event_id", "allowed", "remaining")


@query("stream_breaker")
def stream_breaker(spark, sf_dir):
    return L.decided(_timed(spark, sf_dir), "user_id", ["t", "event_id"], lambda: L.Breaker(2, 6 * 3600, 2), "allowed boolean, state string").select("event_id", "allowed", "state")


@query("stream_throttle")
def stream_throttle(spark, sf_dir):
    return L.decided(_timed(spark, sf_dir).filter("not ok"), "user_id", ["t", "event_id"], lambda: L.Throttle(24 * 3600), "sent boolean").select("event_id", "sent")


@query("stream_single_flight")
def stream_single_flight(spark, sf_dir):
    """A user's requests, one at a time until a purchase completes it or six hours have gone."""
    rows = table(spark, sf_dir, "events")
    timed = rows.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") == "purchase").alias("done"))
    return L.decided(timed, "user_id", ["t", "event_id"], lambda: L.InFlight(6 * 3600), "outcome string").select("event_id", "outcome")


@query("stream_hash_chain")
def stream_hash_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", "text").alias("content"))
    return L.decided(rows, "conv_id", ["turn"], lambda: L.HashChain("key"), "prev_hash string, hash string").select("conv_id", "turn", "prev_hash", "hash")


@query(
    "stream_ready_files",
    """WITH s AS (SELECT user_id AS path, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scan, event_type AS size, 1 AS mtime FROM events), m AS (SELECT *, coalesce(scan - lag(scan) OVER w = 1 AND size = lag(size) OVER w AND mtime = lag(mtime) OVER w, false) AS stable FROM s WINDOW w AS (PARTITION BY path ORDER BY scan)),
    b AS (SELECT *, coalesce(lag(stable) OVER (PARTITION BY path ORDER BY scan), false) AS before FROM m) SELECT CAST(scan AS BIGINT) AS scan, path FROM b WHERE stable AND NOT before""",
)
def stream_ready_files(spark, sf_dir):
    from pyspark.sql import Window

    scan = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    scans = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), scan.cast("long").alias("scan"), F.col("event_type").alias("size"), F.lit(1).alias("mtime"))
    return L.ready_files(scans)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return L.event_windows(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query(
    "stream_sliding",
    "SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL",
)
def stream_sliding(spark, sf_dir):
    return L.event_windows(table(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    return L.sessions(table(spark, sf_dir, "events"))
