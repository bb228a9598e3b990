"""Reports over logs and registries, as-of and interval joins, scopes and upkeep of an index. All are aggregates or equi-joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered


def health(rows: DataFrame, status: str, chunks: str, triplets: str) -> DataFrame:
    """Documents by state, and the sums of their chunks and triplets; a missing number counts as 0."""
    s = F.col(status)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(s == "ready").alias("ready"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("pending", "indexing")).alias("indexing"),
        F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"), F.coalesce(F.sum(triplets), F.lit(0)).alias("triplets"),
    )


def processing(rows: DataFrame, time: str, end: Column, days: int, seconds: Column, hit: Column, calls: Column, failed: Column, cost: float = 0.01) -> DataFrame:
    """Count, mean time, hit rate, cost and error rate of the last `days` before `end`; one row."""
    recent = rows.filter(F.col(time) >= end - F.make_interval(days=F.lit(days)))
    return recent.agg(
        F.count("*").alias("total"), F.round(F.avg(seconds), 6).alias("avg_seconds"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"),
        F.sum(calls).alias("calls"), F.round(F.sum(calls) * cost, 6).alias("cost"), F.round(F.avg(failed.cast("int")), 6).alias("error_rate"),
    )


def load(rows: DataFrame, time: str, latency: str, ok: Column) -> DataFrame:
    """Requests, successes, errors, requests a second and mean latency of a load test."""
    span = F.greatest(F.lit(0.0001), F.unix_micros(F.max(F.col(time).cast("timestamp"))) / 1e6 - F.unix_micros(F.min(F.col(time).cast("timestamp"))) / 1e6)
    return rows.agg(F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.round(F.count("*") / span, 6).alias("rps"), F.round(F.avg(latency), 6).alias("avg_latency"))


def row_digest(columns: list[str]) -> Column:
    """md5 of a row's values, each behind its length; a null has no length, so no two different rows are written alike."""
    fields = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", *fields))


def fingerprint(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order: sha256 of their count and the sums of all four words of their
    128-bit digests. The sums are added up before the shuffle, so a group of any size costs a row per task."""
    row = row_digest(columns)
    sums = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(4)]
    return rows.groupBy(by).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))


def cache_key(parts: dict[str, Column]) -> Column:
    """sha256 of canonical JSON: fields in order, texts quoted, numbers and truth values bare, null as null."""
    fields = []
    for k in sorted(parts):
        bare = F.regexp_extract(F.to_json(F.struct(parts[k].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        fields += [F.lit((", " if fields else "{") + f'"{k}": '), F.when(parts[k].isNull(), "null").otherwise(bare)]
    return F.sha2(F.concat(*fields, F.lit("}")), 256)


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str], block: Column | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; null where there is none.

    A left row without key or time gets nulls, a right one counts for nobody. Of right rows with the same time the largest values count.
    `block`, an expression that rises with the time (its day), cuts the time of a key into parts that are sorted apart and hand the
    last values on; without it a key is sorted in one task.
    """
    given = left.select("*", F.lit(1).alias("_of"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    known = right.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).select(by, time, F.lit(0).alias("_of"), *[F.col(v).alias(f"_{v}") for v in values])
    held = given.unionByName(known, allowMissingColumns=True)
    value = F.when(F.col("_of") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values]))
    out = ordered.carried(held, [by], [time, "_of", *[f"_{v}" for v in values]], F.lit(0) if block is None else block, value, "_last")
    good = F.col(by).isNotNull() & F.col(time).isNotNull()
    return out.filter("_of = 1").select(*left.columns, *[F.when(good, F.col(f"_last.{v}")).alias(f"{v}_as_of") for v in values])


def in_interval(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: float = 1.0) -> DataFrame:
    """Points joined with the intervals [low, high) that hold them: an equi-join on cells and a residual check.

    An interval lies in cells of the power of two (of `width`) that is next above its length, two at most; a point looks into one cell of
    each size that some interval has. Empty intervals hold nothing.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)) / width))).cast("int")
    real = intervals.filter(F.col(low) < F.col(high)).withColumn("_size", size)
    step = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_size"))
    cells = real.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))))
    sizes = F.broadcast(real.select("_size").distinct())  # a row for each power of two, 2,100 at most
    placed = points.filter(F.col(at).isNotNull()).crossJoin(sizes).withColumn("_cell", F.floor(F.col(at) / step))
    return placed.join(cells, ["_size", "_cell"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_size", "_cell")


def in_scope(rows: DataFrame, source: str, allowed: DataFrame) -> DataFrame:
    """`rows` with `in_scope`: whether their source is one of `allowed` (one column of that name); a missing source isn't."""
    known = allowed.select(source).dropna().distinct().withColumn("in_scope", F.lit(True))
    return rows.join(known, source, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def without(rows: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """An index without the rows of some ids or sources. Rows without one stay."""
    return rows.join(gone.select(by).dropna().distinct(), by, "left_anti")


def overridden(rows: DataFrame, other: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """`rows` with columns replaced by the other table's where that has a value; of a key that it has twice the largest value of each column counts."""
    better = other.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return rows.join(better, by, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def or_most_recent(hits: DataFrame, asked: DataFrame, memory: DataFrame, by: str, time: str, n: int = 2) -> DataFrame:
    """The hits, and for those asked (by key) without any hit the `n` most recent rows of their memory."""
    lost = asked.join(hits.select(by).distinct(), by, "left_anti")
    w = Window.partitionBy(by).orderBy(F.desc(time))
    recent = memory.join(lost, by, "left_semi").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
    return hits.withColumn("fallback", F.lit(False)).unionByName(recent.select(*hits.columns).withColumn("fallback", F.lit(True)))
