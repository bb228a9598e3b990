"""Readers and writers for document folders, JSON lines, query files and report exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of files that can be loaded.
TEXT_SUFFIXES = ["txt", "md", "markdown", "csv", "json", "html", "htm", "log", "rst"]


@F.pandas_udf(T.StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    """Spark's own decoder has no GB18030; bytes that aren't any become replacement marks."""
    return content.map(lambda b: bytes(b).decode("gb18030", errors="replace"), na_action="ignore")


def documents(spark: SparkSession, path: str, suffixes: list[str] = TEXT_SUFFIXES) -> DataFrame:
    """(path, suffix, size, mtime, sha256, text) of the text files below a folder; UTF-8, else GB18030. Other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(_gb18030("content"))
    kept = files.withColumn("suffix", suffix).filter(F.col("suffix").isin(suffixes))
    return kept.select("path", "suffix", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), text.alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that aren't JSON of that schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows that come last by `order`; all for n of 0 or less."""
    return rows.orderBy(F.desc(order)).limit(n) if n > 0 else rows


def append_json(rows: DataFrame, path: str, created: str | None = None) -> None:
    """Append rows as JSON lines; a missing `created_at` becomes `created` or now."""
    now = F.lit(created).cast("timestamp") if created else F.current_timestamp()
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    rows = rows.withColumn("created_at", F.coalesce("created_at", stamp) if "created_at" in rows.columns else stamp)
    rows.write.mode("append").json(path)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, category, expected_docs, difficulty) of a JSON file with the key `queries`; an error without that key."""
    whole = spark.read.option("multiLine", "true").json(path)
    if "queries" not in whole.columns:
        raise ValueError(f"{path} has no key 'queries'")
    return whole.select(F.explode("queries").alias("q")).select("q.*")


def query_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines with text, trimmed."""
    lines = spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> ''")
    return lines if limit is None else lines.limit(limit)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """json or csv; in csv, lists, maps and structs are JSON in their cell, and an empty table is its header."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
        flat.write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"{kind} isn't a format for exports")


def html_text(column: str):
    """The text of an HTML page: scripts, styles and tags go, common entities are resolved, white space is one space."""
    c = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def tiers(rows: DataFrame, column: str, as_of: str, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): rows younger than `days` before `as_of`, and the others; a missing time is hot."""
    cold = F.coalesce(F.col(column) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(False))
    return rows.filter(~cold), rows.filter(cold)


def prometheus(metrics: list[tuple[str, str, float]]) -> str:
    """Text exposition of (name, kind, value) rows, already aggregated."""
    lines = []
    for name, kind, value in sorted(metrics):
        lines += [f"# TYPE {name} {kind}", f"{name} {value:g}"]
    return "\n".join(lines) + "\n"
