"""Structure of documents: headings, sections and their parents; audit filters and access predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_level(line: Column) -> Column:
    """1 to 6 for Markdown and numbered headings, capitals and title case; null for other lines."""
    t = F.trim(line)
    hashes = F.length(F.regexp_extract(t, "^(#+)", 1))
    dots = F.length(F.regexp_replace(F.regexp_extract(t, r"^((?:\d+\.)+)\s+[A-Z]", 1), r"[^.]", ""))
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    titled = F.size(F.filter(words, lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")))
    return (
        F.when(t == "", None)
        .when((hashes >= 1) & (hashes <= 6) & (F.trim(F.regexp_replace(t, "^#+", "")) != ""), hashes)
        .when(dots > 0, F.least(dots, F.lit(6)))
        .when(t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}") & F.length(t).between(5, 100), 1)
        .when(t.rlike(r"^\p{Lu}") & ~t.rlike(r"[.!?,]$") & F.size(words).between(2, 15) & (titled / F.greatest(F.size(words), F.lit(1)) > 0.6), 2)
    )


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, section, level, title, content, parent): text by heading; section 0 is what stands before the first.

    The parent is the nearest section before with a smaller level: the last one on a stack that a fold keeps.
    """
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", "line"))
    w = Window.partitionBy("doc").orderBy("i")
    marked = lines.withColumn("level", heading_level(F.col("line"))).withColumn("section", F.count("level").over(w))
    head = F.max(F.when(F.col("level").isNotNull(), F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    rows = marked.groupBy("doc", "section").agg(F.max("level").alias("level"), F.trim(head).alias("title"), body.alias("content"))
    heads = rows.filter("level is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section", "level"))).alias("h"))
    empty = F.array().cast("array<struct<section:bigint,level:int>>")
    start = F.struct(empty.alias("stack"), F.array().cast("array<struct<section:bigint,parent:bigint>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        stack = F.filter(s["stack"], lambda y: y["level"] < x["level"])
        up = F.when(F.size(stack) > 0, F.element_at(stack, -1)["section"])
        return F.struct(F.concat(stack, F.array(F.struct(x["section"].alias("section"), x["level"].alias("level")))).alias("stack"), F.concat(s["done"], F.array(F.struct(x["section"].alias("section"), up.alias("parent")))).alias("done"))

    parents = heads.select("doc", F.explode(F.aggregate("h", start, step, lambda s: s["done"])).alias("p")).select("doc", "p.section", "p.parent")
    return rows.join(parents, ["doc", "section"], "left")


def audit(rows: DataFrame, since: str | None = None, actor: str | None = None, action: str | None = None, keyword: str | None = None, limit: int = 200) -> DataFrame:
    """Log rows that meet all given conditions, the newest first; 1 to 1000 of them."""
    asked = [
        F.col("created_at") >= F.lit(since).cast("timestamp") if since else None,
        F.lower(F.coalesce("actor", F.lit(""))) == actor.lower() if actor else None,
        F.coalesce("action", F.lit("")).contains(action) if action else None,
        F.lower(F.coalesce("detail", F.lit(""))).contains(keyword.lower()) if keyword else None,
    ]
    kept = [c for c in asked if c is not None]
    out = rows.filter(reduce(lambda a, b: a & b, kept)) if kept else rows
    return out.orderBy(F.desc("created_at"), "event_id").limit(max(1, min(1000, limit)))


def visible(user: str, admin: bool, owner: Column, visibility: Column, public: bool = True) -> Column:
    """All for an admin; else one's own, and public ones where allowed."""
    if admin:
        return F.lit(True)
    mine = F.coalesce(owner == user, F.lit(False))
    return mine | (F.coalesce(visibility == "public", F.lit(False)) if public else F.lit(False))


def permitted(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (role, action) with `allowed`: a grant of the action, or of *, to the role; unknown roles have none."""
    exact = grants.select("role", "action", F.lit(True).alias("exact")).distinct()
    star = grants.filter("action = '*'").select("role", F.lit(True).alias("star")).distinct()
    out = requests.join(exact, ["role", "action"], "left").join(star, "role", "left")
    return out.withColumn("allowed", F.coalesce("exact", "star", F.lit(False))).drop("exact", "star")
