"""Blocks of text by their place on a page: rows, columns, reading order, and what a box is by its size and neighbours.

A row begins at its first block and takes what lies within a tolerance of that block, not of the last one. Where two heights that
follow one another are further apart than the tolerance a row begins in any case, so only the heights between two such gaps are
looked at together, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.references import trimmed

# --- Fixed values ---
BULLETS = ["•", "·", "○", "■", "□"]
NUMBERED = r"(?U)^\d+[.、)]"
# --- end of fixed values ---


def with_rows(blocks: DataFrame, page: str, y: str, tolerance: float = 10) -> DataFrame:
    """`blocks` with `row_y`, the height at which the row of a block begins; null without a height. Heights are looked at once each."""
    heights = blocks.select(page, y).dropna(subset=[y]).distinct()
    w = Window.partitionBy(page).orderBy(y)
    apart = heights.withColumn("_run", F.sum(F.when(F.col(y) - F.lag(y).over(w) > tolerance, 1).otherwise(0)).over(w))
    runs = apart.groupBy(page, "_run").agg(F.array_sort(F.collect_list(y)).alias("_ys"))

    def begin(found: Column, at: Column) -> Column:
        return F.when((F.size(found) == 0) | (at - F.element_at(found, -1) > tolerance), F.concat(found, F.array(at))).otherwise(found)

    starts = F.aggregate("_ys", F.slice("_ys", 1, 1), begin)
    placed = runs.select(F.col(page).alias("_page"), F.explode(F.transform("_ys", lambda at: F.struct(at.alias("at"), F.array_max(F.filter(starts, lambda s: s <= at)).alias("row")))).alias("_h"))
    met = blocks.join(placed, F.col(page).eqNullSafe(F.col("_page")) & (F.col(y) == F.col("_h.at")), "left")
    return met.withColumn("row_y", F.col("_h.row")).drop("_page", "_h")


def columns(blocks: DataFrame, page: str, x: str) -> DataFrame:
    """(page, columns): one more than the gaps between left edges that are over twice the mean gap; 1 for fewer than three blocks."""
    edges = blocks.groupBy(page, x).agg(F.count("*").alias("_n"))
    gap = F.col(x) - F.lag(x).over(Window.partitionBy(page).orderBy(x))
    gaps = edges.filter(F.col(x).isNotNull()).withColumn("_gap", gap)
    means = gaps.withColumn("_mean", F.sum("_gap").over(Window.partitionBy(page)) / F.count("_gap").over(Window.partitionBy(page)))
    found = means.groupBy(page).agg(F.sum("_n").alias("_n"), F.count_if(F.col("_gap") > F.col("_mean") * 2).alias("_wide"))
    return found.select(page, F.when(F.col("_n") < 3, 1).otherwise(F.col("_wide") + 1).cast("int").alias("columns"))


def reading_order(blocks: DataFrame, page: str, block: str, x: str, y: str, tolerance: float = 10) -> DataFrame:
    """`blocks` with columns, row_y and place: by height on a page of one column, else row by row and from left to right; ties by the block's id."""
    wide = columns(blocks, page, x).withColumnRenamed(page, "_page")
    rows = with_rows(blocks, page, y, tolerance).join(wide, F.col(page).eqNullSafe(F.col("_page")), "left").drop("_page")
    one = F.coalesce("columns", F.lit(1)) == 1
    order = [F.when(one, F.col(y)).otherwise(F.col("row_y")), F.when(~one, F.col(x)), F.col(block)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(*order)))


def with_kinds(boxes: DataFrame, page: str, block: str, text: str, x: str, y: str, width: str, height: str, page_width: float) -> DataFrame:
    """`boxes` with type and level: title, list_item, table_cell, heading or paragraph by size, place and neighbours on the page.

    A title is 1.5 times as high as the mean, of 30 characters or fewer, and in the middle or nearly the highest; a list item has a bullet
    or number or begins over 20 to the right of the box before (by height, then id); a cell has two boxes or more less than 10 above or below and
    widths that differ by less than twice. Heights are compared to a thousandth. Levels begin at 2, 1.5 and 1.2 times the mean height.
    """
    whole, order = Window.partitionBy(page), Window.partitionBy(page).orderBy(y, block)
    beside = Window.partitionBy(page).orderBy("_y").rangeBetween(-9999, 9999)
    rows = boxes.withColumn("_y", F.round(F.col(y) * 1000).cast("long"))
    rows = rows.withColumns(
        {
            "_mean": F.avg(height).over(whole), "_top": F.max(height).over(whole), "_before": F.lag(x).over(order),
            "_beside": F.count("*").over(beside), "_wide": F.max(width).over(beside), "_narrow": F.min(width).over(beside),
        }
    )
    said, h = trimmed(T.text(text)), F.col(height)
    middle = (F.col(x) + F.col(width) / 2) / page_width
    title = (h >= F.col("_mean") * 1.5) & (F.length(T.text(text)) <= 30) & (((middle > 0.3) & (middle < 0.7)) | (h >= F.col("_top") * 0.9))
    bullet = F.substring(said, 1, 1).isin(BULLETS) | said.rlike(NUMBERED)
    item = bullet | F.coalesce(F.col(x) > F.col("_before") + 20, F.lit(False))
    cell = (F.col("_beside") >= 3) & (F.col("_wide") < F.col("_narrow") * 2)
    kind = F.when(title, "title").when(item, "list_item").when(cell, "table_cell").when(h > F.col("_mean") * 1.2, "heading").otherwise("paragraph")
    ratio = h / F.col("_mean")
    level = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.2, 3).otherwise(0)
    return rows.withColumns({"type": kind, "level": level}).drop("_y", "_mean", "_top", "_before", "_beside", "_wide", "_narrow")
