"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "events_by_type",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type",
)
def events_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))
