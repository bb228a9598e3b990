"""Aggregates over logs: overviews, distributions, the five percentile definitions, alerts and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that a group is cut into.
RANGES = 128


def percentiles(rows: DataFrame, keys: list[str], value: str, marks: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group with a column for each mark (definition, q). Values are counted, not collected.

    floor_n1: sorted[floor(q (n - 1))]; floor_n: sorted[min(floor(q n), n - 1)]; floor_n_less: sorted[max(0, floor(q n) - 1)];
    exclusive: interpolated at q (n + 1), the maximum below 20 values; median: the true median.

    Equal values are counted before anything is ordered. A group's values are cut into ranges of about equal size; a value's places
    are those of the ranges before it and of the values before it in its range, so a group of any size is many small sorts.
    """
    some = rows.filter(F.col(value).isNotNull()).select(F.struct(*keys, F.lit(0).alias("")).alias("_key"), F.col(value).alias("_x"))
    counts = some.groupBy("_key", "_x").agg(F.count("*").alias("_c"))
    bounds = counts.groupBy("_key").agg(F.array_distinct(F.percentile_approx("_x", [i / RANGES for i in range(1, RANGES)], 10_000)).alias("_bounds"), F.sum("_c").alias("_n"))
    placed = counts.join(bounds, "_key").withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_x")))).drop("_bounds")
    sizes = placed.groupBy("_key", "_range").agg(F.sum("_c").alias("_all"))  # at most RANGES rows a group
    before = F.sum("_all").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_all")
    within = F.sum("_c").over(Window.partitionBy("_key", "_range").orderBy("_x"))
    ordered = placed.join(sizes.withColumn("_before", before).drop("_all"), ["_key", "_range"]).withColumn("_end", F.col("_before") + within)
    n, x = F.col("_n"), F.col("_x")

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("_end")) & (place >= F.col("_end") - F.col("_c")), x))

    out = []
    for name, (kind, q) in marks.items():
        if kind == "floor_n1":
            c = at(F.floor(q * (n - 1)))
        elif kind == "floor_n":
            c = at(F.least(F.floor(q * n), n - 1))
        elif kind == "floor_n_less":
            c = at(F.greatest(F.lit(0), F.floor(q * n) - 1))
        elif kind == "exclusive":
            p = q * (n + 1)
            low = F.greatest(F.lit(1), F.least(n - 1, F.floor(p)))
            lower, upper = at(low - 1), at(low)
            c = F.when(F.max(n) < 20, F.max(x)).otherwise(lower + F.max(p - low) * (upper - lower))
        elif kind == "median":
            c = (at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2
        else:
            raise ValueError(kind)
        out.append(c.alias(name))
    found = ordered.groupBy("_key").agg(*out)
    return found.select(*[F.col("_key").getField(k).alias(k) for k in keys], *[F.col(f"`{m}`") for m in marks])


def top_counts(rows: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The n most frequent values; equal counts go by value."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n latest rows of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def calibrated(rows: DataFrame, confidence: str, correct: str, least: int = 5) -> DataFrame:
    """Rows with the accuracy of their confidence's bucket and the calibrated confidence.

    Buckets are [.5,.6) to [.9,1]; less than .5 counts as .5. confidence x accuracy / midpoint, within 0 to 1, from `least` rows on.
    """
    c = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col(confidence)))
    placed = rows.withColumn("bucket", F.least(F.lit(4), F.floor((c - 0.5) * 10 + 1e-9)).cast("int"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    middle = 0.55 + 0.1 * F.col("bucket")
    value = F.when(F.col("n") >= least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence) * F.col("accuracy") / middle))).otherwise(F.col(confidence))
    return placed.join(F.broadcast(sizes), "bucket").withColumn("calibrated", value)


def routed(rows: DataFrame, route: str | None = None, kind: str | None = None, low: float | None = None, high: float | None = None, holds: str | None = None) -> DataFrame:
    """Decisions (route, kind, confidence, question, correct) that meet all given conditions: their number, how many were right, the share
    and the mean confidence; one row. Confidence lies within low and high, the question holds a text in any case."""
    asked = [
        F.col("route") == route if route is not None else None,
        F.col("kind") == kind if kind is not None else None,
        F.col("confidence") >= low if low is not None else None,
        F.col("confidence") <= high if high is not None else None,
        F.contains(F.lower(F.coalesce("question", F.lit(""))), F.lit(holds.lower())) if holds is not None else None,
    ]
    out = rows
    for c in asked:
        out = out if c is None else out.filter(c)
    n, right = F.count("*"), F.count_if("correct")
    return out.agg(n.alias("total"), right.alias("correct"), F.when(n > 0, right / n).otherwise(0.0).alias("accuracy"), F.avg("confidence").alias("confidence"))
