"""What becomes of uploaded files: names made safe, kinds and signatures checked, sizes bounded, duplicates of an owner found.

Each file gets one verdict, the first that applies; only accepted ones are to be stored and indexed. Contents are read once, for
their first bytes, size and digest, and don't travel further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# --- Fixed values: kinds that are taken, and how files of a kind begin (bytes as hex digits) ---
TEXTS = [".txt", ".md"]
IMAGES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tif", ".tiff", ".webp"]
SIGNATURES = {
    ".pdf": "^255044462D",
    ".png": "^89504E470D0A1A0A",
    ".jpg": "^FFD8FF",
    ".jpeg": "^FFD8FF",
    ".gif": "^47494638(37|39)61",
    ".bmp": "^424D",
    ".tif": "^(49492A00|4D4D002A)",
    ".tiff": "^(49492A00|4D4D002A)",
    ".webp": "^52494646.{8}57454250",
}
# --- end of fixed values ---


def safe_name(c: str | Column) -> Column:
    """The last part of a path without slashes, backslashes and double dots; null for nothing, hidden and underscored names."""
    name = F.element_at(F.split(F.regexp_replace(T.text(c), "/+$", ""), "/"), -1)
    bare = F.replace(F.replace(name, F.lit("\\"), F.lit("")), F.lit(".."), F.lit(""))
    return F.when((bare != "") & ~bare.startswith(".") & ~bare.startswith("_"), bare)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^.](\.[^.]+)$", 1))


def signed(kind: Column, content: Column) -> Column:
    """Whether a content begins as files of its kind do; kinds without a signature begin with anything."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.lit(False), False)
    for k, pattern in SIGNATURES.items():
        out = out.when(kind == k, head.rlike(pattern))
    return out.otherwise(True)


def uploaded(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """(owner, place, filename, content) of the files below a folder, as one owner's upload in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit(owner).alias("owner"), F.col("path").alias("place"), F.col("path").alias("filename"), "content")


def judged(files: DataFrame, registry: DataFrame, max_file_bytes: int = 20 << 20, max_total_bytes: int = 100 << 20) -> DataFrame:
    """(owner, place, name, suffix, size, sha256, agent_class, verdict, document_id) of files (owner, place, filename, content).

    Verdicts: hidden (a name that isn't safe), unsupported (its kind), empty (no content, or null), too_large, too_much (the owner's files
    up to it, in the order of `place`, exceed the total), forged (its first bytes aren't its kind's), duplicate (the owner has a registered
    document, not failed, with this digest: its id is given), accepted. `registry` has owner, sha256, document_id and status.
    """
    kinds = [*TEXTS, ".pdf", *IMAGES]
    rows = files.select("owner", "place", safe_name("filename").alias("name"), F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"), signed(suffix(safe_name("filename")), F.col("content")).alias("_signed"))
    rows = rows.withColumn("suffix", suffix(F.col("name")))
    counted = F.when(F.col("name").isNotNull() & F.col("suffix").isin(kinds), F.coalesce("size", F.lit(0))).otherwise(0)
    total = F.sum(counted).over(Window.partitionBy("owner").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    known = registry.filter(F.col("sha256").isNotNull() & ~F.coalesce(F.col("status") == "failed", F.lit(False))).groupBy("owner", "sha256").agg(F.min("document_id").alias("document_id"))
    met = rows.withColumn("_total", total).join(known.withColumn("_known", F.lit(True)), ["owner", "sha256"], "left")
    verdict = (
        F.when(F.col("name").isNull(), "hidden").when(~F.col("suffix").isin(kinds), "unsupported").when(F.coalesce("size", F.lit(0)) == 0, "empty")
        .when(F.col("size") > max_file_bytes, "too_large").when(F.col("_total") > max_total_bytes, "too_much")
        .when(~F.col("_signed"), "forged").when(F.col("_known"), "duplicate").otherwise("accepted")
    )
    named = T.agent_class(F.regexp_replace("name", r"\.[^.]+$", ""))
    agent = F.when(F.col("suffix").isin(".pdf", *IMAGES), "pdf_text").otherwise(named)
    out = met.withColumn("verdict", verdict)
    return out.select("owner", "place", "name", "suffix", "size", "sha256", F.when(F.col("verdict") == "accepted", agent).alias("agent_class"), "verdict", F.when(F.col("verdict") == "duplicate", F.col("document_id")).alias("document_id"))
